"""Declared schemas of the tables that the engine reads; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_s = T.StringType()


def _strings(names: str) -> list[T.StructField]:
    return [T.StructField(n, _s) for n in names.split()]


#: One row a published review.
REVIEWS = T.StructType(_strings("claim_text claimant claim_date publisher_site publisher_name review_url review_title review_date language_code original_rating"))
#: Reviews with a harmonised rating.
GOLD = T.StructType(REVIEWS.fields + [T.StructField("veracity", T.LongType()), *_strings("rating_subtype harmonisation_source judged_axis"), T.StructField("nee", T.BooleanType()), T.StructField("contested", T.BooleanType())])
#: Posts of a captured timeline.
POSTS = T.StructType(_strings("post_id cell domain handle url created_at lang text") + [T.StructField("n_images", T.IntegerType()), T.StructField("n_videos", T.IntegerType()), T.StructField("image_urls", T.ArrayType(_s)), T.StructField("video_urls", T.ArrayType(_s)), *[T.StructField(n, T.LongType()) for n in ("view_count", "like_count", "reply_count", "repost_count")]])
#: Claims taken from posts; keys without a column of their own go to `extra`.
CLAIMS = T.StructType(_strings("post_id claim_id claim type") + [T.StructField("checkworthy", T.BooleanType()), T.StructField("verify_eligible", T.BooleanType()), T.StructField("category", _s), T.StructField("group", T.IntegerType()), T.StructField("removed_reason", _s), T.StructField("extra", T.MapType(_s, _s))])
_READ = T.StructType([T.StructField("direction", _s), T.StructField("evidence", T.ArrayType(T.IntegerType())), T.StructField("qc_flag", _s)])
_RESULT = T.StructType([T.StructField("rank", T.IntegerType()), *_strings("url domain voice"), T.StructField("mirror", T.BooleanType()), T.StructField("rel", _s), T.StructField("ng", T.DoubleType()), T.StructField("leak_flag", T.BooleanType()), T.StructField("read", _READ), T.StructField("sents", T.ArrayType(_s))])
#: One record a claim: the pages that were read for it, in rank order.
RUNS = T.StructType([T.StructField("review_url", _s), T.StructField("veracity", T.IntegerType()), T.StructField("publisher_site", _s), T.StructField("ceiling_src", _s), T.StructField("results", T.ArrayType(_RESULT))])
#: What a run leaves for scoring: rows of (claim, rank, flag).
READS = T.StructType([T.StructField("claim_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("flag", _s)])
CAPTURE = T.StructType(_strings("id full_text screen_name lang created_at url retweeted_by quoted_id") + [T.StructField("promoted", T.BooleanType()), T.StructField("media", T.ArrayType(T.StructType([T.StructField("type", _s), T.StructField("url", _s), T.StructField("bit_rate", T.LongType())])))])
EXCLUSIONS = T.StructType(_strings("claim_id corpus rule source_file decided_on decided_by") + [T.StructField("applied", T.BooleanType()), T.StructField("note", _s)])

"""URL filters: a blocked Bloom filter in front of an exact hash join.

Listed canonical URLs set five bits each in one 64-bit block of a Bloom filter. Its
number of blocks follows the length of the list, ``BITS_AN_URL`` bits for each. Up
to ``MOST_BROADCAST`` blocks, 16 MB, it is broadcast; a larger one is dealt out by
block, and rows meet it in a shuffle. An URL whose bits are not all set is
certainly not listed. The rest are joined with the list itself by hash, which
removes the filter's false positives.

URLs that over one in ``HOT_SHARE`` rows carry are at most ``HOT_SHARE`` many. Their
rows are spread over ``SALTS`` tasks, and they alone stand in the list as often.

Host and path rules come first: a rule fits its host and all subdomains if the
URL's path starts with the rule's path, and the longest fitting rule decides, of
equally long ones the first. Very long URLs are handled like any others: each
pattern takes a URL apart in one pass.

Nulls and odd rows: an URL that is null or has no ``://`` has an empty host and
path and no canonical form, fits no rule and is allowed. Repeated rows each get
a verdict. Empty tables give empty results; further columns of the input stay
out of the way, as only the two named ones are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statline.functions.joins import salted_join
from statline.llm.common import ascii_lower, checkpointed

BITS, BITS_AN_URL = 5, 12
LEAST_BLOCKS, MOST_BROADCAST = 1 << 10, 1 << 20  # of 64 bits: a row of two numbers each
SALTS, HOT_SHARE = 32, 1000

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column, host: Column, path: Column) -> Column:
    """Host without a default port, path without trailing slashes, sorted query
    without tracking parameters; no scheme, no fragment. Null without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)"))
    )
    plain = F.concat(
        F.regexp_replace(host, r":(80|443)?$", ""), F.regexp_replace(path, r"/+$", "")
    )
    joined = F.concat(plain, F.when(F.size(kept) > 0, F.lit("?")).otherwise(""),
                      F.array_join(kept, "&"))
    return F.when(host != "", joined)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule, of equally long ones the first, and its verdict; both null if
    none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules[::-1], key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(
            path, F.lit(rule_path)
        )
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: str) -> Column:
    """A block's bits of one URL, from a second hash."""
    h = F.xxhash64(F.lit("bits"), F.col(url))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def blocks_for(urls: int) -> int:
    """Blocks of a filter of so many URLs: a power of two."""
    return max(LEAST_BLOCKS, 1 << (max(1, urls * BITS_AN_URL // 64) - 1).bit_length())


def bloom_filter(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, word): at most ``blocks`` rows, those that are not empty."""
    return (
        listed.where(F.col(column).isNotNull())
        .groupBy(_block(column, blocks).alias("bloom_block"))
        .agg(F.bit_or(_bits(column)).alias("bloom_word"))
    )


def _probed(rows: DataFrame, column: str, words: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``bloom_hit``: whether all bits of ``column`` are set."""
    marked = rows.withColumn("bloom_block", _block(column, blocks))
    if blocks <= MOST_BROADCAST:
        met = marked.join(F.broadcast(words), "bloom_block", "left")
    else:  # dealt out by block; an URL that very many rows carry is spread
        met = salted_join(marked, words, ["bloom_block"], "left")
    bits = _bits(column)
    possible = F.col(column).isNotNull() & (F.col("bloom_word").bitwiseAND(bits) == bits)
    return met.withColumn("bloom_hit", F.coalesce(possible, F.lit(False))).drop(
        "bloom_block", "bloom_word"
    )


def mark_listed(
    rows: DataFrame, column: str, listed: DataFrame, listed_column: str, blocks: int | None = None
) -> DataFrame:
    """``rows`` with a boolean ``is_listed``: whether ``column`` is in the list.

    The different URLs of the list are stored once, and counted, in the checkpoint folder.
    """
    exact = checkpointed(
        listed.select(F.col(listed_column).alias(column)).where(F.col(column).isNotNull()).distinct()
    )
    blocks = blocks or blocks_for(exact.count())
    probed = _probed(rows, column, bloom_filter(exact, column, blocks), blocks)
    misses = probed.where(~F.col("bloom_hit")).withColumn("is_listed", F.lit(False))
    hits = probed.where(F.col("bloom_hit"))
    hot = F.broadcast(  # at most HOT_SHARE rows
        checkpointed(
            hits.groupBy(column).count().where(F.col("count") > rows.count() / HOT_SHARE)
            .select(column, F.lit(True).alias("hot"))
        )
    )
    is_hot, salts = F.coalesce("hot", F.lit(False)), F.sequence(F.lit(0), F.lit(SALTS - 1))
    spread = (
        exact.join(hot, column, "left")
        .select(column, F.explode(F.when(is_hot, salts).otherwise(F.array(F.lit(0)))).alias("salt"))
        .withColumn("is_listed", F.lit(True))
    )
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int")
    found = (
        hits.join(hot, column, "left")
        .withColumn("salt", F.when(is_hot, salt).otherwise(0)).drop("hot")
        .join(spread.hint("shuffle_hash"), [column, "salt"], "left")
        .withColumn("is_listed", F.coalesce("is_listed", F.lit(False)))
        .drop("salt")
    )
    return found.unionByName(misses).drop("bloom_hit")


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule] = (),
    key: str = "page_id",
    url: str = "url",
    blocks: int | None = None,
) -> DataFrame:
    """``key``, host, path, canonical URL, rule, verdict and ``is_listed`` of each page.

    ``listed`` has one column of canonical URLs to block, see :func:`canonical_url`;
    nulls and repeats in it do not matter. A rule outranks the list. ``blocks`` sets the
    filter's size, which by default follows the list's length.
    """
    parts = pages.select(F.col(key), F.col(url).alias("url")).select(
        key, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    parts = parts.withColumn(
        "canonical", canonical_url(F.col("url"), F.col("host"), F.col("path"))
    ).drop("url")
    marked = mark_listed(parts, "canonical", listed, listed.columns[0], blocks)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    listed_verdict = F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select(
        key, "host", "path", "canonical", rule.alias("rule"),
        F.coalesce(verdict, listed_verdict).alias("verdict"), "is_listed",
    )


def seen_again(pages: DataFrame, url: str = "url") -> DataFrame:
    """Canonical URLs that more than one page carries."""
    column = F.col(url)
    form = canonical_url(column, host_of(column), path_of(column))
    return (
        pages.select(form.alias("listed_url"))
        .where("listed_url IS NOT NULL")
        .groupBy("listed_url")
        .count()
        .where("count > 1")
        .select("listed_url")
    )

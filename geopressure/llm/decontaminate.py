"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts are cut into lower-cased words of letters and digits. A seed looks at a few consecutive words
through a fixed mask that selects some positions and ignores the others, so a substituted word under
an ignored position does not break it. Seeds of the benchmark items are joined with seeds at every
position of every document. Around each hit the two word sequences are aligned and compared:
``ceil(min_share * w)`` of the ``w`` aligned words in reach must be equal, and ``min_equal`` words at
least (all but one of a shorter item).

The masks select five words of six or eight. Of random substitutions, 3 in 15 words, 5 in 20 and 8 in
30 left a seed in all of 1,500 trials each, so the share decides; ``tests/llm`` measures the recall of
the whole operator. Items of four to seven words are sought through one mask for each position that is
left out, so one substitution anywhere is tolerated. Items of one to three words are matched exactly,
wherever they stand; items without words never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopressure.llm.keys import only_keys, without_keys
from geopressure.llm.store import Scratch

#: Selected positions of each mask, for items of SPAN words or more.
MASKS = ((0, 1, 3, 4, 5), (0, 1, 3, 6, 7), (0, 2, 3, 5, 7))
SPAN = 8
#: Items below this many words are matched without a substitution.
EXACT = 4
#: Copies of each seed where the benchmark's side is shuffled, so that a frequent one is spread.
SALTS = 16
#: Seeds up to which the benchmark's side is broadcast (about 64 bytes each); beyond, it is shuffled.
MAX_BROADCAST_SEEDS = 500_000


def words(text: Column) -> Column:
    """Hashes of the lower-cased words (runs of letters and digits) of a text, in order."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _seeds(h: str, pos: str, lengths: list[int]) -> Column:
    """Seed hashes at a position: one for each mask, and those of each short item length in use."""
    at = lambda k: F.get(F.col(h), F.col(pos) + k)
    out = [F.when(F.col(pos) + mask[-1] < F.size(h), F.xxhash64(F.lit(i), *[at(k) for k in mask])) for i, mask in enumerate(MASKS)]
    for n in lengths:
        # The number ``n`` leaves no word out.
        for left in range(n) if n >= EXACT else [n]:
            mask = [at(k) for k in range(n) if k != left]
            out.append(F.when(F.col(pos) + n <= F.size(h), F.xxhash64(F.lit(100 * n + left + 1), *mask)))
    return F.array(*out)


def _positions(df: DataFrame, idents: list[str], lengths: list[int]) -> DataFrame:
    """One narrow row for each position and mask; the words stay inside one generated loop.

    The outer form keeps the optimiser from adding a filter that would cut every text twice.
    """
    return df.select(*idents, "h", F.posexplode_outer("h").alias("pos", "w")).select(
        *idents, "pos", F.posexplode(_seeds("h", "pos", lengths)).alias("mask", "seed")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.6, reach: int = 4, min_equal: int = 8) -> DataFrame:
    """Pairs of documents and benchmark items that overlap.

    ``docs(doc_id, text, ...)`` and ``benchmark(item_id, text, ...)`` give one row for each pair:
    ``doc_id, item_id, n_hits`` (verified seeds), ``first_word`` (position in the document where the
    item would begin, least over hits; negative if the item's beginning is cut off) and ``matched``
    (most equal words around a hit). The comparison takes the seed's words and up to ``reach`` more
    on either side, as far as both texts go. Null or empty texts give no rows; texts of any length are
    searched whole. Rows of one id with the same words count once, however often they repeat; different texts of one
    id, or of none, are searched each and grouped under that id or null. Other columns are ignored.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("h")).where(F.size("h") > 0)
    size = items.agg(F.sum(F.size("h") * len(MASKS)), F.collect_set(F.when(F.size("h") < SPAN, F.size("h")))).first()
    lengths = sorted(size[1])
    numbered = items.withColumn("__item", F.xxhash64("item_id", "h"))
    seeds = _positions(numbered.where(F.size("h") >= SPAN), ["__item"], [])
    for n in lengths:
        seeds = seeds.unionByName(_positions(numbered.where(F.size("h") == n), ["__item"], [n]).where("pos = 0"))
    seeds = seeds.where("seed is not null").select("seed", "__item", F.col("pos").alias("bpos")).distinct()
    text = F.xxhash64("h").alias("__text")
    found = _positions(docs.select("doc_id", words(F.col("text")).alias("h")).select("doc_id", "h", text), ["doc_id", "__text"], lengths)
    if (size[0] or 0) <= MAX_BROADCAST_SEEDS:
        near = found.join(F.broadcast(seeds), "seed")
    else:
        spread = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS)).cast("int")
        near = found.where("seed is not null").withColumn("salt", salt).join(spread, ["seed", "salt"])
    scratch = Scratch(docs.sparkSession, "decontaminate")
    # At one place there are as many masks as seeds; a row that repeats gives the same ones again.
    masks = F.size(F.collect_set("mask")).cast("long").alias("count")
    diagonal = near.groupBy("doc_id", "__text", "__item", (F.col("pos") - F.col("bpos")).alias("offset"), "bpos").agg(masks)
    hits = scratch.save(diagonal)
    named = only_keys(docs.select("doc_id", "text"), hits.select("doc_id"), "doc_id")
    full = named.select(F.col("doc_id").alias("__id"), words(F.col("text")).alias("h")).withColumn("__same", F.xxhash64("h"))
    full = full.join(hits.select("__text").distinct(), F.col("__same") == F.col("__text"), "left_semi").dropDuplicates(["__id", "__same"])
    of = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__same"))
    hits = hits.join(numbered.distinct().withColumnRenamed("h", "bh"), "__item").join(full, of)
    begin = F.greatest(F.col("bpos") - reach, F.lit(0), -F.col("offset"))
    end = F.least(F.col("bpos") + SPAN + reach, F.size("bh"), F.size("h") - F.col("offset"))
    aligned = hits.withColumn("begin", begin).withColumn("width", end - begin)
    same = F.zip_with(
        F.slice("bh", F.col("begin") + 1, F.col("width")),
        F.slice("h", F.col("begin") + F.col("offset") + 1, F.col("width")),
        lambda x, y: x == y,
    )
    return (
        aligned.select(
            "doc_id", "item_id", "count", "offset", "width", F.size("bh").alias("n"), F.size(F.filter(same, lambda x: x)).alias("m")
        )
        .where(F.col("m") >= F.ceil(F.lit(min_share) * F.col("width")))
        .where(F.col("m") >= F.when(F.col("n") < EXACT, F.col("n")).otherwise(F.least(F.lit(min_equal), F.col("n") - 1)))
        .groupBy("doc_id", "item_id")
        .agg(
            F.sum("count").alias("n_hits"),
            F.min("offset").cast("long").alias("first_word"),
            F.max("m").cast("long").alias("matched"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, all columns as they were."""
    return without_keys(docs, contaminated(docs, benchmark).select("doc_id"), "doc_id")

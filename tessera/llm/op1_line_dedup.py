"""Fuzzy line deduplication in DataFrame functions only.

1. Lines are keyed by a 64-bit hash and collapsed to distinct ones, with the place
   of their first occurrence.  They are written once, bucketed by their key, so
   that neither the signatures nor the verification shuffles them all again.
2. A line's set of SHINGLE-byte shingles is reduced to BANDS x ROWS minima.  Every
   shingle is hashed once to 64 bits; the four rotations of the hash by 16 bits
   and masks that are spread evenly over the range make the functions.  A minimum
   under a mask is the shingle next to it, and no two functions look at the same
   part of the range of the same rotation.
3. A bucket's members are not all paired: each meets the head of its group, and heads
   meet those of larger groups (candidates).  Minima, one byte each, drop pairs
   that agree in fewer than LEAST of them (3 pairs in 10^6 at the threshold); the
   rest are verified by the exact Jaccard similarity of their shingle sets, and
   verified pairs are joined by a distributed union-find (components).
4. Buckets whose members still lie in several components are taken up again.  First
   neighbours in them that agree most are verified, so that families of near copies
   become few components (this settles nothing by itself).  Then, in what is open, in
   buckets of at most SMALL members, members of different components that agree often
   enough are verified.  In larger ones a semi-join tells which lines agree with
   any member of another component, without making pairs; those lines, and all
   lines of buckets of over WHOLE members, meet by an exact prefix join
   (candidates.prefix_pairs).

Of each component, and of each line that occurs more than once, the first
occurrence (doc_id, line number) stays.  At the threshold of 0.8 a pair shares no
band with probability 4 x 10^-5, at 0.85 with 2 x 10^-6.  Lines of fewer than
SHORT bytes have no shingle and are compared exactly only; blank lines always stay.
Two different lines of one key, which a second hash shows, stay as they are.

Null and empty texts have one blank line.  Rows without doc_id come after all
others; repeated rows stay alike: the same place of the same document is not its
own duplicate.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import candidates, common
from .components import components

SHINGLE, BANDS, ROWS, PERCENT = 8, 14, 3, 80
FUNCTIONS = BANDS * ROWS
LANES = 4
#: Shingles to a row, whose minima are taken before the aggregate's.
BLOCK = 24
LEAST, SMALL, WHOLE = 21, 64, 4096
CLOSE, AHEAD = 32, 3
SHORT = SHINGLE
LAST = (1 << 63) - 1


def place() -> Column:
    """doc and line_no, in this order."""
    return F.struct("doc", "line_no")


def line_rows(docs: DataFrame) -> DataFrame:
    """doc, mark (of the text), line_no, line, id and place of every line that isn't blank."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return rows.where(F.trim("line") != "").select("doc", "mark", "line_no", "line", F.xxhash64("line").alias("id"), place().alias("place"))


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def turned(x: Column, lane: int) -> Column:
    return x if not lane else F.shiftleft(x, 16 * lane).bitwiseOR(F.shiftrightunsigned(x, 64 - 16 * lane))


def minima() -> list[Column]:
    """The functions' minima over the rotations of the hashes x0 .. of a row's shingles.
    Those of one band are of different rotations."""
    masks = -(-FUNCTIONS // LANES)
    value = lambda j, k: turned(F.col(f"x{k}"), j % LANES).bitwiseXOR(F.lit(_signed((j // LANES * (1 << 16) // masks) << 48)))
    return [F.min(F.least(*[value(j, k) for k in range(BLOCK)])).alias(f"m{j}") for j in range(FUNCTIONS)]


def band_key(b: int) -> Column:
    """One number of a band's minima and the band.  They are hashes, and of different
    rotations, so that xor does not cancel them even where they are of one shingle; to
    hash them once more takes a fifth of the time of all signatures."""
    tag = F.lit(_signed((b + 1) * 0x9E3779B97F4A7C15))
    return functools.reduce(Column.bitwiseXOR, [F.col(f"m{b * ROWS + r}") for r in range(ROWS)], tag)


def signatures(lines: DataFrame) -> DataFrame:
    """(id, keys, w0 ..): the band keys of each distinct line, and its minima, a byte
    each, seven to a number; lines must be partitioned by id."""
    long_enough = lines.where(F.octet_length("line") >= SHORT).select("id", F.col("line").cast("binary").alias("b"))
    exploded = long_enough.select("id", "b", F.explode(F.expr(f"sequence(1, octet_length(b) - {SHINGLE - 1}, {BLOCK})")).alias("i"))
    # the last row's places past the end are the last shingle once more
    hashed = exploded.select("id", *[F.xxhash64(F.expr(f"substring(b, least(i + {k}, octet_length(b) - {SHINGLE - 1}), {SHINGLE})")).alias(f"x{k}") for k in range(BLOCK)])
    signed = hashed.groupBy("id").agg(*minima())
    keys = [band_key(b) for b in range(BANDS)]
    words = []
    for w in range(0, FUNCTIONS, 7):
        word = F.lit(0).cast("long")
        for k, j in enumerate(range(w, min(w + 7, FUNCTIONS))):
            word = word.bitwiseOR(F.shiftleft(F.col(f"m{j}").bitwiseAND(F.lit(0xFF)), 8 * k))
        words.append(word.alias(f"w{w // 7}"))
    return signed.select("id", F.array(*keys).alias("keys"), *words)


WORDS = [f"w{k}" for k in range(-(-FUNCTIONS // 7))]


def band_rows(lines: DataFrame) -> DataFrame:
    """(id, key) per band of each distinct line."""
    return signatures(lines).select("id", F.explode("keys").alias("key"))


def differing(a: str, b: str) -> Column:
    """How many bytes of the words of two signatures differ."""
    total = F.lit(0)
    for w in WORDS:
        x = F.col(f"{a}{w}").bitwiseXOR(F.col(f"{b}{w}"))
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x01010101010101)))
    return total


def alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs whose minima agree often enough for the threshold."""
    of = lambda c, side: signed.select(F.col("id").alias(c), *[F.col(w).alias(f"{side}{w}") for w in WORDS])
    both = pairs.join(of("v", "a"), "v").join(of("u", "b"), "u")
    return both.where(differing("a", "b") <= FUNCTIONS - LEAST).select("u", "v")


def let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(line: Column) -> Column:
    """The line's shingles, as numbers: on strings of eight bytes, xxHash64 is one to one
    (each of its steps can be undone), so equal numbers are equal shingles and the
    similarity is exact.  The bytes are taken once, not copied for each shingle."""
    return let(line.cast("binary"), lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - SHINGLE + 1), lambda i: F.xxhash64(F.substring(b, i, F.lit(SHINGLE)))))


def verified(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets of shingles reach the similarity, as a written table."""
    right = pairs.join(lines.select(F.col("id").alias("v"), F.col("line").alias("lv")), "v")
    # a line's array is made once for all pairs that it is the lesser of
    lesser = lines.join(pairs.select(F.col("u").alias("id")).distinct(), "id").select(F.col("id").alias("u"), shingles(F.col("line")).alias("a"))
    # outside of lambdas these run compiled, on arrays of numbers; sizes are written first, as
    # a filter on them would go below the arrays and compute each several times.  Sets are no
    # larger than arrays, so most pairs that fail do so by the size of the union alone
    arrays = right.join(lesser, "u").select("u", "v", "a", shingles(F.col("lv")).alias("b"))
    union = F.size(F.array_union("a", "b")).cast("long")
    may = 100 * (F.size("a") + F.size("b") - union) >= percent * union
    both_sizes = (F.size(F.array_distinct("a")) + F.size(F.array_distinct("b"))).cast("long")
    sizes = arrays.select("u", "v", F.when(may, both_sizes).alias("sum"), union.alias("union"))
    return common.materialize(sizes, "line-verified").where(F.expr(f"100 * (sum - union) >= {percent} * union")).select("u", "v")


def neighbours(opened: DataFrame) -> DataFrame:
    """Pairs of lines of different components that stand within AHEAD of each other among
    a bucket's lines, in the order of one of their words, and agree in CLOSE minima."""
    turn, by = F.pmod("key", F.lit(len(WORDS))), F.col(WORDS[0])
    for k, w in enumerate(WORDS[1:], 1):
        by = F.when(turn == k, F.col(w)).otherwise(by)
    bucket = Window.partitionBy("key").orderBy(by, "id")
    line = F.struct(F.col("id").alias("v"), F.col("component").alias("other"), *[F.col(w).alias(f"b{w}") for w in WORDS])
    ahead = opened.select("id", "component", *[F.col(w).alias(f"a{w}") for w in WORDS], F.array(*[F.lead(line, k).over(bucket) for k in range(1, AHEAD + 1)]).alias("ahead"))
    met = ahead.select("id", "component", *[f"a{w}" for w in WORDS], F.inline(F.filter("ahead", lambda x: x["other"] != F.col("component"))))
    return met.where(differing("a", "b") <= FUNCTIONS - CLOSE).select(F.least("id", "v").alias("u"), F.greatest("id", "v").alias("v")).distinct()


def with_words(opened: DataFrame, signed: DataFrame) -> DataFrame:
    return opened if WORDS[0] in opened.columns else opened.join(signed.select("id", *WORDS), "id")


def open_pairs(held: DataFrame, comps: DataFrame, signed: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of lines of different components that share a bucket."""
    opened = common.materialize(with_words(candidates.opened(held, comps), signed), "line-opened")
    worded = opened.where(f"members <= {WHOLE}")
    one = worded.select("key", "members", "id", "component", *[F.col(w).alias(f"a{w}") for w in WORDS])
    two = worded.select(F.col("key").alias("k"), F.col("id").alias("v"), F.col("component").alias("other"), *[F.col(w).alias(f"b{w}") for w in WORDS])
    agree = (F.col("key") == F.col("k")) & (differing("a", "b") <= FUNCTIONS - LEAST)
    small = one.where(f"members <= {SMALL}").join(two, agree & (F.col("component") < F.col("other")))
    small = small.select(F.least("id", "v").alias("u"), F.greatest("id", "v").alias("v")).distinct()
    near = one.where(f"members > {SMALL}").join(two, agree & (F.col("component") != F.col("other")), "left_semi")
    ids = near.select("id", "component").union(opened.where(f"members > {WHOLE}").select("id", "component")).distinct()
    # written first: else Spark would compute the sets of all lines, to drop empty ones before the join
    texts = common.materialize(lines.join(ids, "id").join(signed.select("id", *WORDS), "id").select("id", "component", "line", *WORDS), "line-open-texts")
    sets = common.spread(texts, "id").select("id", "component", *WORDS, F.array_distinct(shingles(F.col("line"))).alias("s"))
    found = candidates.prefix_pairs(sets, percent, WORDS, differing("a", "b") <= FUNCTIONS - LEAST)
    return small.union(found).distinct()


def bucketed(df: DataFrame, label: str) -> tuple[DataFrame, str, str]:
    """df as a table bucketed by id, its name and path."""
    spark = df.sparkSession
    name, parts = f"tessera_{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{common.scratch_root(spark)}/tessera-{name}"
    df.write.bucketBy(parts, "id").format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    common.keep_scratch(spark, path)
    common.tidy(spark)
    return spark.table(name), name, path


def sharing(held: DataFrame, signed: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, line, w0 ..) of the lines that share a bucket.  Their ids are the side that is
    hashed, so that the other lines are passed over without being sorted."""
    ids = held.select("id").distinct().hint("shuffle_hash")
    return lines.select("id", "line").join(ids, "id", "left_semi").join(signed.select("id", *WORDS).join(ids, "id", "left_semi"), "id")


def keepers(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(id, keep): the place that stays, for each line with other occurrences or near copies."""
    spark = docs.sparkSession
    other = F.xxhash64(F.lit(1), "line")
    distinct = line_rows(docs).withColumn("other", other).groupBy("id").agg(F.min("line").alias("line"), F.min("place").alias("first"), F.count("*").alias("n"), (F.min("other") != F.max("other")).alias("clash"))
    lines, *table = bucketed(distinct.where("NOT clash").drop("clash"), "lines")
    signed, *more = bucketed(signatures(lines), "signatures")
    held = common.materialize(candidates.members(signed.select("id", F.explode("keys").alias("key"))), "line-buckets")
    # all that follows is about these lines, a small part of all
    shared, *third = bucketed(sharing(held, signed, lines), "shared")
    signed, texts = shared.select("id", *WORDS), shared.select("id", "line")
    pairs = common.materialize(alike(candidates.pairs(held), signed), "line-pairs")
    links = verified(pairs, texts, percent)
    comps = components(links, "line-components")
    opened = common.materialize(with_words(candidates.opened(held, comps), signed), "line-opened")
    near = common.materialize(neighbours(opened).join(pairs, ["u", "v"], "left_anti"), "line-neighbours")
    linked = verified(near, texts, percent)
    if not linked.isEmpty():  # components only grow, so buckets that aren't open now won't be
        links = links.union(linked)
        comps = components(links, "line-components")
    tried = pairs.union(near)
    fresh = common.materialize(open_pairs(opened.drop("component"), comps, signed, texts, percent).join(tried, ["u", "v"], "left_anti"), "line-open-pairs")
    found = verified(fresh, texts, percent)
    if not found.isEmpty():  # nothing that lies across components is untried now
        comps = components(links.union(found), "line-components")
    placed = lines.select("id", "first", "n").join(comps.withColumnRenamed("node", "id").hint("shuffle_hash"), "id", "left").where("n > 1 OR component IS NOT NULL")
    placed = common.materialize(placed.select("id", F.coalesce("component", "id").alias("component"), "first"), "line-placed")
    best = placed.groupBy("component").agg(F.min("first").alias("keep"))
    kept = common.materialize(placed.join(best, "component").select("id", "keep"), "line-keepers")
    for name, path in (table, more, third):
        spark.sql(f"DROP TABLE {name}")  # an external table: its files are deleted apart
        common.remove(spark, [path])
    return kept


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc, mark, removed): numbers of the lines that go, per document that loses any."""
    docs = common.doc_texts(docs)
    rows = line_rows(docs).select("doc", "mark", "line_no", "id")
    gone = rows.join(keepers(docs, percent), "id").where(place() != F.col("keep"))
    return gone.groupBy("doc", "mark").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def line_dedup(docs: DataFrame, percent: int = PERCENT, drop_emptied: bool = False) -> DataFrame:
    """docs with duplicate lines taken out of text (and n_chars, if there is one, set
    anew).  A text that loses all lines but blank ones becomes empty; with drop_emptied
    its row goes.  Other columns, whatever their names, pass as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    plain = docs.toDF(*names)
    doc_id, text = F.col(at["doc_id"]), F.col(at["text"])
    gone = removed_lines(docs.select("doc_id", "text"), percent)
    keyed = plain.withColumns({"doc": F.coalesce(doc_id.cast("long"), F.lit(LAST)), "mark": F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))})
    joined = keyed.join(gone, ["doc", "mark"], "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("removed", i)), "\n")
    joined = joined.withColumn("left", F.when(F.col("removed").isNotNull(), F.when(left.rlike("[^ \n]"), left).otherwise("")))
    joined = joined.where("left IS NULL OR left <> ''") if drop_emptied else joined
    kept, whole = F.col("left"), F.col("left").isNull()
    changed = {"text": F.when(whole, text).otherwise(kept)}
    if "n_chars" in at:
        count = F.col(at["n_chars"])
        changed["n_chars"] = F.when(whole, count).otherwise(F.length(kept).cast(dict(docs.dtypes)["n_chars"]))
    return joined.select(*[changed.get(c, F.col(n)).alias(c) for c, n in at.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_removed and the removed line numbers."""
    docs = common.doc_texts(common.table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("mark"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"))
    out = counted.join(removed_lines(docs), ["doc", "mark"], "left")
    none = F.expr("cast(array() as array<int>)")
    return out.select("doc_id", "n_lines", F.size(F.coalesce("removed", none)).cast("long").alias("n_removed"), F.array_join(F.coalesce("removed", none), ",").alias("removed_lines"))

"""Fuzzy line deduplication by MinHash (operator 2). DataFrame functions only.

Lines are compared lower-cased and trimmed. A line's signature comes from all its shingles of SHINGLE characters: a
shingle's hash falls into one of RANGES ranges, and the least hash of each range is kept (one-permutation hashing; an
empty range borrows from the others in a fixed order). One byte of each value is the sketch, which costs 32 bytes a
line; BANDS bands of ROWS bytes of it are the buckets in which lines meet. Pairs whose sketches agree in fewer than LIKE
places of 32 are no candidates (at a similarity of 0.8 about 26 agree); all others are decided by exact Jaccard
similarity over all their shingles, which are told apart by 64-bit hashes, as lines are.

Lines that are in a bucket with none that is alike by sketch leave it before any text is fetched. In what is left of a bucket
every line meets the least line first, and then its neighbours in two orders of the sketches, which gives
a few pairs a line and bucket. Buckets that this leaves in several components are gone through again: their lines outside the main
component meet all lines of other components, and pairs are made only of lines whose marks leave it open whether they are similar.
Where these are more than CUT, the bucket's lines meet by their rarest shingles instead, so many that two similar lines
share one (prefix filter), which leaves out no similar pair. A line's shingles are put in order within its row. Components come from distributed union-find, and the first
line (least document key, then position) of each component stays.

Texts are fetched once, for the lines that may have to be compared, and are looked at only for pairs that are candidates.
Lines are told apart by two 64-bit hashes; in the graph by the first of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loadspan.llm.components import connected_components
from loadspan.llm.tables import written

THRESHOLD = 0.8
SHINGLE = 5
RANGES, ROWS = 32, 4
BANDS = RANGES // ROWS
#: Hashes of a range that are looked at, on average; of a longer line the higher ones cannot be the least but in e ** -KEPT of all ranges, which borrow.
KEPT = 3
LIKE = 20
CUT = 4096
#: Lines whose shingles are counted to tell which are rare (any order of them is right), and the hash values that they are counted by.
COUNTED, SLOTS = 20_000, 1 << 15
#: Rows of rare shingles that are shuffled at once, in so many parts at most.
PART_ROWS, PARTS = 2_000_000, 8
#: Bits of the filter that keeps other lines' texts out of the shuffle; its table is FILTER_BITS / 8 bytes at most.
FILTER_BITS = 1 << 23
#: Words of 64 bits in which a line's shingles are marked, to tell which pairs cannot be similar.
MARKS = 32
_BLANK = " \t\x0b\x0c\r"
_SKETCH = ["_s0", "_s1", "_s2", "_s3"]
#: Columns that are aggregated at once; as many bytes has a word of the sketch.
WIDTH = 8
#: Where an empty range borrows, in turn: so many ranges on in its word.
LENT = (0, 5, 3, 6, 1, 7, 2, 4)


def signatures(lines: DataFrame, by: list[str], line: str = "_line", more: tuple[str, ...] = ()) -> DataFrame:
    """by, more, _bands array<long> and the sketch for each distinct value of the columns by, which tell lines apart.

    Numbers of a line in the columns more cost less than in by.

    Characters are laid out four bytes each, so that a shingle is cut out without counting through the line; shingles
    are rows that are aggregated before the shuffle. A line shorter than a shingle is one shingle.
    """
    bits = 64 - (RANGES.bit_length() - 1)
    coded = lines.select(*by, *more, F.encode(line, "UTF-32").alias("_e"))
    n = F.greatest(F.lit(1), F.expr(f"length(_e) div 4 - {SHINGLE - 1}"))
    # neither null nor a column of its own to explode: Spark would filter by them first, and code each line once more for that
    bar = F.coalesce((F.lit(2.0**bits) * F.least(F.lit(1.0), F.lit(float(KEPT * RANGES)) / n)).cast("long"), F.lit(0).cast("long"))
    each = coded.select(*by, *more, "_e", bar.alias("_bar"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_i"))
    hashed = each.select(*by, *more, "_bar", "_i", F.xxhash64(F.expr(f"substring(_e, 4 * _i + 1, {4 * SHINGLE})")).alias("_h"))
    low = hashed.select(*by, *more, "_bar", "_i", F.col("_h").bitwiseAND(F.lit((1 << bits) - 1)).alias("_v"), F.shiftrightunsigned("_h", bits).cast("int").alias("_r"))
    # the first shingle counts for no range if it is not low, but a line that repeats a few shingles may have no other row
    low = low.where("_v < _bar or _i = 0").withColumn("_to", F.when(F.expr("_v < _bar"), F.col("_r").bitwiseAND(F.lit(WIDTH - 1))).otherwise(F.lit(WIDTH)))
    # the ranges of one word of the sketch at once: their bytes are packed before the words of a line are put together
    some = low.groupBy(*by, F.shiftright("_r", WIDTH.bit_length() - 1).alias("_part"))
    # neither null: Spark takes the least of such values faster
    none, held = F.lit((1 << 63) - 1), [F.min(c).alias(c) for c in more]
    some = some.agg(*held, F.min("_v").alias("_least"), *[F.min(F.when(F.col("_to") == i, F.col("_v")).otherwise(none)).alias(f"_m{i}") for i in range(WIDTH)])
    picked = [F.coalesce(*[F.nullif(F.col(f"_m{(i + k) % WIDTH}"), none) for k in LENT]) for i in range(WIDTH)]
    words = some.select(*by, *more, "_part", "_least", _packed(picked).alias("_word"))
    least = words.groupBy(*by).agg(*held, F.min("_least").alias("_least"), *[F.max(F.when(F.col("_part") == i, F.col("_word"))).alias(s) for i, s in enumerate(_SKETCH)])
    # a line of few shingles has words without any: they borrow the least of all
    sketch = [F.coalesce(s, _packed([F.col("_least")] * WIDTH)).alias(s) for s in _SKETCH]
    return least.select(*by, *more, *sketch).select(*by, *more, F.array(*[_band(j) for j in range(BANDS)]).alias("_bands"), *_SKETCH)


def _packed(values: list[Column]) -> Column:
    """A byte of each of the values in one word: another byte for each row of a band, as lines of few shingles have the same value in many."""
    return reduce(Column.bitwiseOR, [F.shiftleft(F.shiftrightunsigned(v, 8 * (i % ROWS)).bitwiseAND(F.lit(255).cast("long")), 8 * i) for i, v in enumerate(values)])


def _band(j: int, prefix: str = "") -> Column:
    """The j-th bucket of a line: ROWS bytes of its sketch, and j above them."""
    bits = 8 * ROWS
    part = F.shiftrightunsigned(prefix + _SKETCH[j * bits // 64], j * bits % 64)
    return part.bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(j << bits))


def _alike(a: str, b: str) -> Column:
    """Whether the sketches in the columns of these prefixes agree in LIKE places."""

    def other(s: str) -> Column:
        x = F.col(a + s).bitwiseXOR(F.col(b + s))
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return reduce(Column.__add__, map(other, _SKETCH)) <= RANGES - LIKE


def _hashes(line: Column) -> Column:
    """array<long>: the hash of each shingle of a line, repeats included; a line shorter than a shingle is one."""
    at = lambda e: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(e) - (4 * SHINGLE - 1)), F.lit(4))
    # an array of one binds the coded line, which would be coded again for each shingle
    return F.transform(F.array(F.encode(line, "UTF-32")), lambda e: F.transform(at(e), lambda i: F.xxhash64(F.substring(e, i, F.lit(4 * SHINGLE)))))[0]


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """(_key, _doc, _pos, _line, _k1, _k2) and the columns more for each line with a character that is not white space; docs: (_key, _text, more)."""
    split = docs.select(*more, "_key", F.xxhash64("_text").alias("_doc"), F.posexplode(F.split("_text", "\n")).alias("_pos", "_raw"))
    lines = split.withColumn("_raw", F.btrim("_raw", F.lit(_BLANK))).where("_raw <> ''").withColumn("_line", F.lower("_raw")).drop("_raw")
    return lines.withColumns({"_k1": F.xxhash64("_line"), "_k2": F.xxhash64("_line", F.lit(1))})


def _signed(docs: DataFrame) -> DataFrame:
    """(_k1, _k2, _at and the sketch) for each distinct line; _at (_key, _doc, _pos) is its first place.

    Rows of docs are dealt out before they are split: a line's shingles are aggregated within its task, so that what is
    shuffled is the texts once and some 70 bytes a line, not the least hashes of all ranges. Equal lines have equal sketches.
    """
    dealt = docs.select("_key", "_text", F.monotonically_increasing_id().alias("_row")).repartition("_row")
    signed = signatures(_lines(dealt, "_row"), ["_row", "_pos", "_key"], more=("_doc", "_k1", "_k2"))
    return signed.groupBy("_k1", "_k2").agg(F.min(F.struct("_key", "_doc", "_pos")).alias("_at"), *[F.min(s).alias(s) for s in _SKETCH])


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_k1, _line) for the wanted _k1. A bitmap of bounded size keeps most other lines out of the shuffle."""
    slot = F.pmod("_k1", F.lit(FILTER_BITS))
    bitmap = wanted.select(slot.alias("v")).groupBy(F.expr("bitmap_bucket_number(v)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(v))").alias("_bits"))
    lines = _lines(docs).select("_k1", "_line", slot.alias("v"))
    # never null: Spark would filter by that first, and hash each line once more for it
    lines = lines.withColumns({c: F.coalesce(F.expr(f"{f}(v)"), F.lit(-1).cast("long")) for c, f in (("_bucket", "bitmap_bucket_number"), ("_bit", "bitmap_bit_position"))})
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    # at most FILTER_BITS / 32768 + 1 rows of 4 KB
    near = lines.join(F.broadcast(bitmap), "_bucket").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0)
    return near.groupBy("_k1").agg(F.min("_line").alias("_line")).join(wanted, "_k1", "left_semi")


def _enough(a: str, b: str, n: Column, threshold: float) -> Column:
    """Whether the lines in these columns, of n distinct shingles in all, have at least that Jaccard similarity.

    The hashes are of 64 bits, by which whole lines are told apart, too.
    """
    return F.size(F.array_intersect(_hashes(F.col(a)), _hashes(F.col(b)))) >= n * (threshold / (1 + threshold)) - 1e-9


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def _alike_rows(buckets: DataFrame, sketches: DataFrame) -> DataFrame:
    """(_key, _head, _k1 and the sketch) for the lines of each bucket that are alike to another line of it; _head is the least of them.

    A line meets others until one is alike, and gives one row at most.
    """
    rows = buckets.join(sketches.select("_k1", *_SKETCH), "_k1").select("_key", "_k1", *_SKETCH)
    left, right = _prefixed(rows, "a"), _prefixed(rows, "b")
    found = left.join(right, (F.col("a_key") == F.col("b_key")) & (F.col("a_k1") != F.col("b_k1")) & _alike("a", "b"), "left_semi")
    found = found.withColumn("a_head", F.min("a_k1").over(Window.partitionBy("a_key")))
    return found.select([F.col("a" + c).alias(c) for c in ("_key", "_head", "_k1", *_SKETCH)])


def _stars(rows: DataFrame) -> DataFrame:
    """(a, b): each line of a bucket with its least line, where the sketches are alike."""
    left, right = _prefixed(rows.where("_k1 = _head"), "a"), _prefixed(rows.where("_k1 <> _head"), "b")
    met = left.join(right, (F.col("a_key") == F.col("b_key")) & _alike("a", "b"))
    return met.select(F.col("a_k1").alias("a"), F.col("b_k1").alias("b")).distinct()


def _parted(rows: DataFrame) -> DataFrame:
    """rows (_key, _k1, _c, ...) of the keys whose lines are in several components, with the key's _main one, its least line's."""
    several = rows.groupBy("_key").agg(F.min_by("_c", "_k1").alias("_main"), F.min("_c").alias("lo"), F.max("_c").alias("hi")).where("lo <> hi")
    return rows.join(several.select("_key", "_main"), "_key")


def _neighbours(parted: DataFrame) -> DataFrame:
    """(a, b): lines of different components that follow one another in a bucket by sketch, read forwards or backwards, and are alike."""
    out = None
    for order in (_SKETCH, _SKETCH[::-1]):
        near = Window.partitionBy("_key").orderBy(*order, "_k1")
        pairs = parted.select([F.col(c).alias("b" + c) for c in parted.columns] + [F.lag(c).over(near).alias("a" + c) for c in ("_k1", "_c", *_SKETCH)])
        pairs = pairs.where((F.col("a_c") != F.col("b_c")) & _alike("a", "b")).select(F.col("a_k1").alias("a"), F.col("b_k1").alias("b"))
        out = pairs if out is None else out.union(pairs)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _across(parted: DataFrame, texts: DataFrame, threshold: float, marks: DataFrame | None = None) -> DataFrame:
    """(a, b): lines of one bucket but of different components that may be similar.

    A bucket's lines outside its main component meet all lines of other components, if they are CUT at most, and make a
    pair where their marks allow it; larger buckets' lines meet by their rarest shingles. parted: (_key, _k1, _c, _main
    and the sketch).
    """
    marks = _marks(texts) if marks is None else marks
    sizes = parted.where("_c <> _main").groupBy("_key").agg(F.count(F.lit(1)).alias("_m"))
    small, large = (sizes.where(x).select("_key") for x in (F.col("_m") <= CUT, F.col("_m") > CUT))
    marked = parted.join(small, "_key", "left_semi").join(marks.withColumnRenamed("_n", "_shingles"), "_k1")
    left = _prefixed(marked.where("_c <> _main"), "a")
    meet = (F.col("a_key") == F.col("b_key")) & (F.col("a_c") != F.col("b_c")) & ((F.col("b_c") == F.col("b_main")) | (F.col("a_k1") < F.col("b_k1")))
    # a pair counts in the first bucket that it shares only
    at = F.shiftrightunsigned("a_key", 8 * ROWS)
    for j in range(BANDS - 1):
        meet &= (at <= j) | (_band(j, "a") != _band(j, "b"))
    meet &= _alike("a", "b") & _near("a", "b", "_shingles", threshold)
    found = left.join(_prefixed(marked, "b"), meet).select(F.col("a_k1").alias("a"), F.col("b_k1").alias("b"))
    wide = written(parted.join(large, "_key", "left_semi").select("_k1", "_c", *_SKETCH).distinct().join(texts, "_k1"), "large")
    return found if wide.isEmpty() else found.union(_open(_by_rarest(wide, threshold), marks, threshold).select("a", "b")).distinct()


def _by_rarest(lines: DataFrame, threshold: float) -> DataFrame:
    """(a, b): lines (_k1, _c, _line and the sketch) of different components that are alike and share one of their rarest shingles.

    In any one order of all shingles, two lines of n and m shingles and that similarity share one of their first
    n - threshold * n + 1 and m - threshold * m + 1, and behind the first shared one enough are left in both lines for
    as many as they must share. Their numbers of shingles are as near as the similarity, too. A line's shingles are put
    in order within its row, and the shared ones are looked for in up to PARTS parts, so that little is shuffled at once.
    """
    n = lines.count()
    key = _ordered(_frequency(lines, max(1, n // COUNTED)))
    ranked = lines.select("_k1", "_c", *_SKETCH, key.alias("_all")).withColumn("_n", F.size("_all"))
    first = ranked.withColumn("_all", F.slice("_all", 1, F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9).cast("int") + 1))
    first = written(first.select("_k1", "_c", *_SKETCH, "_n", F.posexplode("_all").alias("_i", "_g")), "rarest")
    near = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * threshold - 1e-9
    near &= F.least(F.col("a_n") - F.col("a_i"), F.col("b_n") - F.col("b_i")) >= (F.col("a_n") + F.col("b_n")) * (threshold / (1 + threshold)) - 1e-9
    parts, found = min(PARTS, 1 + first.count() // PART_ROWS), None
    for j in range(parts):
        some = first.where(F.pmod("_g", F.lit(parts)) == j)
        left, right = _prefixed(some, "a"), _prefixed(some, "b")
        met = left.join(right, (F.col("a_g") == F.col("b_g")) & (F.col("a_c") < F.col("b_c")) & near & _alike("a", "b"))
        met = met.select(F.col("a_k1").alias("a"), F.col("b_k1").alias("b")).distinct()
        if parts > 1:
            met = written(met, "met")
        found = met if found is None else found.union(met)
    return found.distinct() if parts > 1 else found


def _shingle_hashes(lines: DataFrame, *columns: str) -> DataFrame:
    """columns and _h, the hash of a shingle, for each shingle of each line, repeats included."""
    coded = lines.select(*columns, F.encode("_line", "UTF-32").alias("_e"))
    each = coded.select(*columns, "_e", F.explode(F.expr(f"sequence(0, greatest(0, cast(length(_e) div 4 as int) - {SHINGLE}))")).alias("_i"))
    return each.select(*columns, F.xxhash64(F.expr(f"substring(_e, 4 * _i + 1, {4 * SHINGLE})")).alias("_h"))


def _frequency(lines: DataFrame, step: int) -> bytes:
    """How often shingles of every step-th line have each of SLOTS hash values, as a byte of up to 127: twelve times the binary logarithm.

    It says in which order shingles are tried; any order finds the same pairs.
    """
    some = _shingle_hashes(lines.where(F.pmod("_k1", F.lit(step)) == 0))
    counts = some.groupBy(F.col("_h").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("_s")).agg(F.least(F.lit(127.0), 12 * F.log2(F.count(F.lit(1)) + 1)).cast("int").alias("_f"))
    out = bytearray(SLOTS)
    for r in counts.collect():
        out[r["_s"]] = r["_f"]
    return bytes(out)


def _ordered(frequency: bytes) -> Column:
    """array<long>: a number for each distinct shingle of _line, ascending; 7 bits of it are its frequency, the others its hash's."""
    held = F.lit(frequency)
    often = lambda h: F.ascii(F.substring(held, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int") + 1, F.lit(1)).cast("string")).cast("long")
    return F.sort_array(F.transform(F.array_distinct(_hashes(F.col("_line"))), lambda h: F.shiftleft(often(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))


def _marks(texts: DataFrame) -> DataFrame:
    """_k1, _n and _w0 ...: how many distinct shingles a line has, and a bit for the hash of each."""
    # outer: there is no line without a shingle, and Spark would make each list once more to leave out empty ones
    each = texts.select("_k1", F.explode_outer(F.array_distinct(_hashes(F.col("_line")))).alias("_h"))
    bit = each.select("_k1", F.expr("shiftleft(1L, cast(_h & 63 as int))").alias("_bit"), F.expr(f"cast(shiftrightunsigned(_h, 6) & {MARKS - 1} as int)").alias("_w"))
    # some words at once, and never null: an aggregate of more columns costs each row a look at all of them
    none, parts = F.lit(0).cast("long"), MARKS // WIDTH
    some = bit.groupBy("_k1", F.col("_w").bitwiseAND(F.lit(parts - 1)).alias("_part"))
    some = some.agg(F.count(F.lit(1)).alias("_n"), *[F.bit_or(F.when(F.shiftright("_w", parts.bit_length() - 1) == i, F.col("_bit")).otherwise(none)).alias(f"_c{i}") for i in range(WIDTH)])
    words = [F.bit_or(F.when(F.col("_part") == j % parts, F.col(f"_c{j // parts}")).otherwise(none)).alias(f"_w{j}") for j in range(MARKS)]
    return some.groupBy("_k1").agg(F.sum("_n").alias("_n"), *words)


def _near(a: str, b: str, n: str, threshold: float) -> Column:
    """Whether the marks in the columns of these prefixes leave it open that the lines are similar.

    Lines of n and m shingles and that similarity differ in (1 - threshold) / (1 + threshold) * (n + m) shingles at most,
    and so in no more marks.
    """
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"{a}_w{j}").bitwiseXOR(F.col(f"{b}_w{j}"))) for j in range(MARKS)])
    return apart <= (F.col(a + n) + F.col(b + n)) * ((1 - threshold) / (1 + threshold)) + 1e-9


def _open(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that may be similar by their marks, with _n, their distinct shingles together."""
    left, right = (_prefixed(marks, k).withColumnRenamed(f"{k}_k1", k) for k in "ab")
    return pairs.join(left, "a").join(right, "b").where(_near("a", "b", "_n", threshold)).select("a", "b", (F.col("a_n") + F.col("b_n")).alias("_n"))


def _similar(pairs: DataFrame, texts: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose lines are similar; those that are ruled out by their marks need no look at the texts."""
    left, right = (texts.select(F.col("_k1").alias(k), F.col("_line").alias(f"_{k}")) for k in "ab")
    return written(_open(pairs, marks, threshold).join(left, "a").join(right, "b").where(_enough("_a", "_b", F.col("_n"), threshold)).select("a", "b"), "similar")


def _components(docs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """(node, component) over _k1 for the lines that are similar to others."""
    met = signed.select("_k1", F.explode(F.array(*[_band(j) for j in range(BANDS)])).alias("_key"))
    buckets = written(met.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_key"))).where("_n > 1").select("_key", "_k1"), "buckets")
    rows = written(_alike_rows(buckets, signed), "alike")
    texts = written(_texts(docs, rows.select("_k1").distinct()), "lines")
    marks = written(_marks(texts), "marks")
    linked = _similar(_stars(rows), texts, marks, threshold)
    found = written(connected_components(linked), "components")
    parted = written(_parted(_placed(rows.drop("_head"), found)), "parted")
    near = _similar(_neighbours(parted), texts, marks, threshold)
    if not near.isEmpty():
        linked = linked.union(near)
        found = written(connected_components(linked), "components")
        parted = written(_parted(_placed(parted.drop("_c", "_main"), found)), "parted")
    more = _similar(written(_across(parted, texts, threshold, marks), "across"), texts, marks, threshold)
    return found if more.isEmpty() else connected_components(linked.union(more))


def _placed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with _c, the component of their _k1."""
    return rows.join(found, F.col("_k1") == F.col("node"), "left").withColumn("_c", F.coalesce("component", "_k1")).drop("node", "component")


def _lost(signed: DataFrame, found: DataFrame) -> DataFrame:
    """(_k1, _k2) of the lines that are not the first of their component."""
    of = signed.select("_k1", "_k2", "_at").join(found, F.col("_k1") == F.col("node"))
    first = of.groupBy("component").agg(F.min("_at").alias("_first"))
    return of.join(first, "component").where("_at <> _first").select("_k1", "_k2")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with text less its repeated lines, n_lines and n_kept (long): lines that are not blank, before and after.

    Of lines that are similar at threshold or over, directly or by way of others, the first over all documents stays,
    as it is written there. Blank lines stay. Null texts stay null, with no lines. Documents are told apart by key and
    text: rows that repeat both keep the same lines. All rows stay, even those that lose every line; an empty table
    stays empty. Columns named n_lines or n_kept are replaced.
    """
    df = df.drop("n_lines", "n_kept")
    docs = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    signed = written(_signed(docs), "signatures")
    found = written(_components(docs, signed, threshold), "components")
    lost = written(_lost(signed, found), "lost")
    first = signed.join(lost, ["_k1", "_k2"], "left_anti").select("_at.*")
    kept = first.groupBy("_key", "_doc").agg(F.sort_array(F.collect_list("_pos")).alias("_kept"))
    kept = kept.withColumnRenamed("_key", "_k")
    rows = df.withColumn("_doc_", F.xxhash64(F.col(text).cast("string")))
    rows = rows.join(kept, rows[key].eqNullSafe(kept["_k"]) & (rows["_doc_"] == kept["_doc"]), "left").drop("_k", "_doc", "_doc_")
    rows = rows.withColumn("_all", F.split(F.col(text).cast("string"), "\n"))
    blank = lambda s: F.btrim(s, F.lit(_BLANK)) == ""
    stays = F.filter("_all", lambda s, i: blank(s) | F.coalesce(F.array_contains("_kept", i), F.lit(False)))
    rows = rows.withColumns({
        "n_lines": F.coalesce(F.size(F.filter("_all", lambda s: ~blank(s))), F.lit(0)).cast("long"),
        "n_kept": F.coalesce(F.size("_kept"), F.lit(0)).cast("long"),
        text: F.array_join(stays, "\n"),
    })
    return rows.select(*df.columns, "n_lines", "n_kept")

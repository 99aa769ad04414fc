"""Winnowed document fingerprints (DataFrame and SQL functions only).

A text is its UTF-8 bytes.  Every ``K`` consecutive bytes are hashed (32 bits of
xxhash64); of every ``WINDOW`` consecutive hashes the smallest is kept, the
rightmost of equal ones, with its byte position.  So any ``K + WINDOW - 1`` bytes
that two texts share are seen: both keep the same hash inside them
(``matches`` reads the places).  A text of fewer hashes is one window, one of
fewer than ``K`` bytes is one hash; an empty text keeps none.

A hash and its position are one long, ``hash << 31 | (2**31 - 1 - position)``, so
the window minimum is a plain minimum.  Minima over windows double in width
(1, 2, 4, ...), and long texts go through in pieces of ``PIECE`` windows that overlap, so
no array is longer than a piece but the kept ones.

A text's windows are gone through once, on the scan; the places of its kept hashes move with
it, and where they are wanted only the bytes at these places are hashed again.
The edited text differs from the text in its second half only, so what the text keeps of the
windows inside the first half holds for both, and only those behind are made anew.

Scale: equal rows are combined before the one shuffle of texts.  The neighbour
table holds an id, a hash and a length per document; it is placed in total order
by range partitions.  Then only the wanted start of the next text and its hashes
move, to a frame that is already dealt by the same key.  Nothing is collected.

Defined results: NULL text is empty; NULL ids come last (descending order).
Documents of the same id are ordered by (hash, length) of their text; rows with the same id and the
same text are one document, and each gets its result.  A single document is its own
next one.  Two fingerprints without hashes are alike (1), one without
and one with are not (0).  Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualityspark.llm import common
from qualityspark.operators.ordered import Ordered

K = 16
#: a power of two, or three times one
WINDOW = 32
#: windows that are worked on at once
PIECE = 1 << 14
LAST = (1 << 31) - 1
HASH_BITS = ((1 << 32) - 1) << 31
KEY = ["kd", "kz", "kh", "kn"]


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once.  Inside, a binary is not copied at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _mark(data: Column, i: Column, end: Column, k: int) -> Column:
    return F.xxhash64(F.substring(data, i + 1, F.lit(k))).bitwiseAND(F.lit(HASH_BITS)).bitwiseOR(end - i)


def _marks(data: Column, at: Column, count: Column, k: int) -> Column:
    """Hash and position of the first ``count`` k-grams of ``data``, which begins at byte ``at``."""
    end = F.lit(LAST) - at
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: _mark(data, i, end, k))


def _strides(window: int) -> list[list[int]]:
    """Steps that widen a minimum to ``window`` values, two to four places at once."""
    out, wide = [], 1
    while wide < window:
        many = next(m for m in (4, 3, 2) if window // wide % m == 0)
        out.append([wide * j for j in range(1, many)])
        wide *= many
    return out


def _widest(marks: Column, strides: list[list[int]]) -> Column:
    """Minimum of each value and those after it; windows at the end are cut short."""
    if not strides:
        return marks
    wider = let(marks, lambda a: F.transform(a, lambda x, i: F.least(x, *[F.get(a, i + F.lit(o)) for o in strides[0]])))
    return _widest(wider, strides[1:])


def minima(data: Column, first: Column, last: Column, k: int = K, window: int = WINDOW, piece: int = PIECE) -> Column:
    """Distinct minima of the windows ``first..last`` (0-based) of binary ``data``, in
    window order; none if ``last`` is smaller."""
    def part(d, s):
        windows = F.least(F.lit(piece), last - s + 1)
        span = F.substring(d, s + 1, windows + F.lit(window + k - 2))
        marks = let(span, lambda p: _marks(p, s, windows + F.lit(window - 1), k))
        return F.array_distinct(F.slice(_widest(marks, _strides(window)), F.lit(1), windows))

    whole = let(data, lambda d: F.flatten(F.transform(F.sequence(first, last, F.lit(piece)), lambda s: part(d, s))))
    return F.when(last >= first, whole).otherwise(_none())


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _few(data: Column, grams: Column, k: int) -> Column:
    """The one window of a text of fewer than ``window`` hashes."""
    return F.when(grams > 0, F.array(F.array_min(let(data, lambda d: _marks(d, F.lit(0), grams, k))))).otherwise(_none())


def _grams(size: Column, k: int) -> Column:
    return F.when(size > 0, F.greatest(size - F.lit(k - 1), F.lit(1))).otherwise(F.lit(0))


def selected(data: Column, size: Column, k: int = K, window: int = WINDOW, piece: int = PIECE, behind: tuple[Column, Column] | None = None) -> Column:
    """Selected marks of binary ``data`` of ``size`` bytes, in order of position.
    ``behind``: (number of leading windows, their minima) if they are known."""
    grams = _grams(size, k)
    start, head = behind or (F.lit(0), _none())
    rest = F.array_distinct(F.concat(head, minima(data, start, grams - window, k, window, piece)))
    return F.when(grams < window, _few(data, grams, k)).otherwise(rest)


def places(marks: Column) -> Column:
    """The byte positions of marks."""
    return F.transform(marks, lambda m: (F.lit(LAST) - m.bitwiseAND(F.lit(LAST))).cast("int"))


def marks_at(data: Column, at: Column, k: int = K) -> Column:
    """The marks of binary ``data`` whose places are known."""
    return let(data, lambda d: F.transform(at, lambda i: _mark(d, i, F.lit(LAST), k)))


def leading(marks: Column, data: Column, lead: Column, k: int = K, window: int = WINDOW, piece: int = PIECE) -> Column:
    """Those of the selected ``marks`` of ``data`` that are minima of its first ``lead`` windows.  The
    places of minima never go back, so they are the marks up to the minimum of the last such window."""
    last = F.when(lead > 0, F.get(minima(data, lead - 1, lead - 1, k, window, piece), F.lit(0)))
    # a later place is a smaller number; none are kept where there is no such window
    return let(last.bitwiseAND(F.lit(LAST)), lambda to: F.filter(marks, lambda m: m.bitwiseAND(F.lit(LAST)) >= to))


def hashes(marks: Column) -> Column:
    """The distinct hashes of marks, as ints (less 2**31)."""
    return F.array_distinct(F.transform(marks, lambda m: (F.shiftright(m, 31) - F.lit(LAST + 1)).cast("int")))


def written(marks: Column) -> Column:
    """``hash@position`` in hexadecimal and decimal digits, comma-joined."""
    return F.array_join(F.transform(marks, lambda m: F.concat_ws(
        "@", F.lpad(F.lower(F.hex(F.shiftright(m, 31))), 8, "0"), (F.lit(LAST) - m.bitwiseAND(F.lit(LAST))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / union)


def matches(a: Column, b: Column) -> Column:
    """Places where two mark arrays agree: structs (at_a, at_b) of byte positions,
    one for each mark of ``a`` whose hash ``b`` keeps too (its last place there)."""
    def place(m):
        return (F.lit(LAST) - m.bitwiseAND(F.lit(LAST))).cast("int")

    hash_of = lambda m: F.shiftright(m, 31)
    return F.transform(F.filter(a, lambda m: F.exists(b, lambda o: hash_of(o) == hash_of(m))), lambda m: F.struct(
        place(m).alias("at_a"), F.array_max(F.transform(F.filter(b, lambda o: hash_of(o) == hash_of(m)), place)).alias("at_b")))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return t.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("kd"), F.col("doc_id").isNull().alias("kz"),
                    F.xxhash64("text").alias("kh"), F.length("text").alias("kn"), "text")


def neighbours(docs: DataFrame) -> DataFrame:
    """Per document: its key, its number of rows ``m``, and the key (``p_`` columns)
    of the one before it, whose next it is."""
    keys = docs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("m"))
    placed = Ordered(keys.withColumn("down", F.bitwise_not("kd")), None, ["down", "kz", "kh", "kn"]).indexed()
    placed = common.materialize(placed.select(*KEY, "m", "_idx", F.col("_n").alias("all")))
    before = placed.select(F.when(F.col("_idx") == F.col("all"), F.lit(1)).otherwise(F.col("_idx") + 1).alias("_idx"),
                           *[F.col(c).alias(f"p_{c}") for c in KEY])
    return common.materialize(placed.join(before, "_idx").drop("_idx", "all"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW,
                 piece: int = PIECE) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and ``marks`` / ``edited_marks``
    (hash and position as longs)."""
    rows = _documents(docs, id_col, text_col)
    near = neighbours(rows)
    cut = (k, window, piece)
    kept = rows.withColumn("at", places(selected(F.encode("text", "UTF-8"), F.octet_length("text"), *cut)))
    texts = kept.groupBy(*KEY).agg(F.first("text").alias("text"), F.first("at").alias("at")).join(near, KEY)
    data = texts.withColumn("data", F.encode("text", "UTF-8"))
    sent = data.select(*[F.col(f"p_{c}").alias(c) for c in KEY], F.expr("substring(text, 1, p_kn div 2)").alias("start"),
                       hashes(marks_at(F.col("data"), F.col("at"), k)).alias("next_hashes"))
    j = data.select(*KEY, "text", "data", "at", "m").join(sent, KEY)
    j = j.withColumn("half", F.expr("substring(text, 1, kn - kn div 2)"))
    j = j.withColumn("edited", F.encode(F.concat("half", "start"), "UTF-8"))
    # windows that end inside the first half
    j = j.withColumn("lead", F.greatest(F.lit(0), F.octet_length("half") - F.lit(k + window - 2)))
    j = j.select(*KEY, "m", "data", "edited", "lead", "next_hashes", marks_at(F.col("data"), F.col("at"), k).alias("marks"))
    j = j.withColumn("head", leading(F.col("marks"), F.col("data"), F.col("lead"), *cut))
    j = j.withColumn("edited_marks", selected(F.col("edited"), F.octet_length("edited"), *cut, (F.col("lead"), F.col("head"))))
    j = j.select(*KEY, "m", "marks", "edited_marks", "next_hashes", F.sha2("edited", 256).alias("edited_sha256"),
                 hashes(F.col("marks")).alias("own_hashes"), hashes(F.col("edited_marks")).alias("edited_hashes"))
    j = j.select(F.when(~F.col("kz"), F.col("kd")).alias("doc_id"), F.col("kn").cast("long").alias("n_chars"), "edited_sha256",
                 written(F.col("marks")).alias("fingerprint"), written(F.col("edited_marks")).alias("edited_fingerprint"),
                 likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"),
                 likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"), "marks", "edited_marks", "m")
    return j.withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("m")


@common.register("op12_document_fingerprints")
def op12(spark, sf):
    return fingerprints(common.table(spark, sf, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

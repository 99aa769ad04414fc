"""Main text of HTML pages: block structure and nearest-URL page differencing.

A page is read into blocks (lines of text) with a zone each: *boiler* (inside
menus, headers, footers, sidebars, notices, adverts, forms, comments), *main*
(inside an article or main element) or *open* (anything else).  Pages of a host
are ordered by path; every page is paired with the neighbour whose path shares the
longer prefix, their lines are aligned by a longest common subsequence, and the
shared lines are template lines.

Differencing alone is wrong on pages whose menus and adverts change from page to
page and whose articles are copied, so the zones come first: boiler lines always
go, lines of an article element stay, and open lines stay unless they are shared,
whether the page has an article element or not.  A copy of its neighbour, whose article
and open lines are all shared, keeps its lines.

Scale: the pairing shuffles line hashes only.  Pages are range-partitioned by
(host, path) and numbered with partition offsets, so a host with a third of all
pages is many partitions, and neighbours meet by a join on the number.  Texts
are extracted in a second scan; only pages that lose lines are shuffled for it.

Defined results: NULL or blank html gives an empty text; unclosed elements and a cut-off
end are read as far as they go; a NULL url has an empty host; equal (id, html)
rows lose the same lines.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from qualityspark.llm import common

# fixed values: element and attribute words of HTML pages
RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|select|title"
BLOCKS = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre
section summary table tbody td tfoot th thead tr ul""".split())
CONTAINERS = frozenset("""article aside body dialog div dl fieldset figure footer form head header html main menu nav ol
section table ul button""".split())
BOILER = frozenset("aside dialog footer form header menu nav button head".split())
MAIN = frozenset(["article", "main"])
#: boiler whatever they hold
STRICT = BOILER - {"form"}
NOISE = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
cookie cookies consent footer header login masthead menu modal nav navbar navigation newsletter notice notices popup promo
promoted related share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget widgets""".split())
#: words that say where or how, not what: a class or id is noise if it is made of noise words and these only
NEUTRAL = frozenset("""area bar block bottom box buttons center col column container content global group holder icons inner
item items left links list main outer overlay page panel post posts primary reader region right row secondary section site slot
sticky sub top unit user wrap wrapper zone""".split())
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
ROLE = re.compile(r"\b(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu)\b")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
TAG = re.compile(rf"""<!--.*?(?:-->|\Z)
    |<(?P<raw>{RAW})(?=[\s/>])[^>]*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)(?:>|\Z)
    |<[!?/][^>]*(?:>|\Z)""", re.X | re.S | re.I)


def _noise_name(token: str) -> bool:
    words = [w.lower() for w in PARTS.findall(token)]
    return any(w in NOISE for w in words) and all(w in NOISE or w in NEUTRAL for w in words)


def _is_noise(name: str, attrs: str) -> bool:
    if name in BOILER:
        return True
    if not attrs or name in ("html", "body"):
        return False
    if HIDDEN.search(attrs):
        return True
    for key, value in NAMES.findall(attrs):
        if key.lower() == "role":
            if ROLE.search(value.lower()):
                return True
        elif any(map(_noise_name, value.strip("\"'").split())):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of every non-empty block, in page order.  A form, or an element named like boiler, is
    none if it holds the page's longest article or, on a page without article text, more than four
    fifths of all text.  Linear in the page."""
    found: list[tuple[int, str]] = []  # container, text
    if not page:
        return []
    # containers: 0 is the page
    up, noise, strict, main, size = [0], [False], [False], [False], [0]
    stack: list[tuple[str, int]] = [("", 0)]
    count: dict[str, int] = {}
    held: list[str] = []

    def flush():
        if held:
            text = "".join(held)
            held.clear()
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                found.append((stack[-1][1], text))
                size[stack[-1][1]] += len(text)

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            held.append(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"]:
                if m["raw"].lower() in ("title", "textarea", "select"):
                    flush()
            continue
        name = name.lower()
        if name not in BLOCKS:
            continue
        flush()
        if name not in CONTAINERS:
            continue
        if not m["end"]:
            if not m["attrs"].endswith("/"):
                up.append(stack[-1][1])
                noise.append(_is_noise(name, m["attrs"]))
                strict.append(name in STRICT)
                main.append(name in MAIN)
                size.append(0)
                stack.append((name, len(up) - 1))
                count[name] = count.get(name, 0) + 1
        elif count.get(name):
            while True:
                top, _ = stack.pop()
                count[top] -= 1
                if top == name:
                    break
    if at < len(page):
        held.append(page[at:])
    flush()
    for c in range(len(up) - 1, 0, -1):  # children come after their parent
        size[up[c]] += size[c]
    longest = max((c for c in range(len(up)) if main[c] and not noise[c]), key=lambda c: size[c], default=0)
    bare = not size[longest] or not longest
    while longest:
        longest = up[longest]
        noise[longest] = noise[longest] and strict[longest]
    for c in range(1, len(up)):
        page_wide = bare and not strict[c] and 5 * size[c] > 4 * size[0]
        noise[c] = noise[up[c]] or noise[c] and not page_wide
        main[c] = main[up[c]] or main[c]
    return [("boiler" if noise[c] else "main" if main[c] else "open", t) for c, t in found]


def common_lines(a: list, b: list) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``.  Row i of the table of lengths is a
    whole number with a zero bit wherever the length grows, and comes from the row before by a few
    operations on whole rows; every ``step``-th row is kept and the others are made again on the way
    back.  Many equal lines cost no more than different ones."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo:len(a) - hi], b[lo:len(b) - hi]
    at: dict = {}
    for j, v in enumerate(y):
        at.setdefault(v, []).append(j)
    places = {}
    for v in set(x) & set(at):
        bits = bytearray(len(y) // 8 + 1)
        for j in at[v]:
            bits[j >> 3] |= 1 << (j & 7)
        places[v] = int.from_bytes(bits, "little")
    full = (1 << len(y)) - 1

    def rows(start, row, end):
        out = [row]
        for i in range(start, end):
            p = places.get(x[i], 0)
            if p:
                u = row & p
                row = (row + u | row - u) & full
            out.append(row)
        return out

    step = max(1, int(len(x) ** 0.5))
    kept, row = [], full
    for s in range(0, len(x), step):
        kept.append(row)
        row = rows(s, row, min(s + step, len(x)))[-1]
    middle, mask = [], full
    length = (~row & mask).bit_count()
    for k in range(len(kept) - 1, -1, -1):
        if not length:
            break
        block = rows(k * step, kept[k], min((k + 1) * step, len(x)))
        for i in range(len(block) - 1, 0, -1):
            if (~block[i - 1] & mask).bit_count() < length:
                middle.append(k * step + i - 1 + lo)
                mask = (1 << (~block[i] & mask).bit_length() - 1) - 1  # what lies before the matched line
                length -= 1
    return [*range(lo), *reversed(middle), *range(len(a) - hi, len(a))]


def main_text(page: str | None, shared: set[int] | None = None) -> str:
    """Article lines and the open lines that are not shared, in page order."""
    return " ".join(t for i, (z, t) in enumerate(blocks(page)) if z == "main" or z == "open" and not (shared and i in shared))


def _line_hashes(pages: DataFrame) -> DataFrame:
    def scan(batches):
        for batch in batches:
            lines, zones = [], []
            for t in batch.column(4):
                b = blocks(t.as_py())
                lines.append([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                              for _, x in b])
                zones.append([z for z, _ in b])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(lines, pa.list_(pa.int64())),
                                              pa.array(zones, pa.list_(pa.string()))],
                                             names=["page_id", "hash", "host", "path", "lines", "zones"])

    return pages.mapInArrow(scan, "page_id long, hash long, host string, path string, lines array<long>, zones array<string>")


def shared_lines(pages: DataFrame) -> DataFrame:
    """(__id, __hash, cut): per page that loses any, the numbers of its open
    lines shared with the nearest page of its host."""
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = common.materialize(_line_hashes(pages))
    # the global order: range partitions, numbered with the sizes of those before
    order = ["host", "path", "page_id", "hash"]
    placed = common.materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                                .withColumn("at", F.monotonically_increasing_id()))
    split = F.shiftright("at", 33)
    sizes = placed.groupBy(split.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    number = (placed.withColumn("part", split).join(F.broadcast(before), "part")
              .withColumn("g", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before"))
    side = lambda step, p: number.select((F.col("g") + step).alias("g"), F.struct("host", "path", "lines").alias(p))
    pairs = (number.join(side(1, "prev"), "g", "left").join(side(-1, "next"), "g", "left")
             .where(F.array_contains("zones", "open"))
             .select("page_id", "hash", "host", "path", "lines", "zones", "prev", "next"))

    def align(batches):
        for batch in batches:
            ids, hashes, cuts = [], [], []
            for r in batch.to_pylist():
                near = None
                for other in (r["prev"], r["next"]):
                    if other and other["host"] == r["host"]:
                        n = next((i for i, (x, y) in enumerate(zip(r["path"], other["path"])) if x != y),
                                 min(len(r["path"]), len(other["path"])))
                        if near is None or n > near[0]:
                            near = (n, other)
                if near:
                    same = [i for i in common_lines(r["lines"], near[1]["lines"]) if r["zones"][i] != "boiler"]
                    cut = [i for i in same if r["zones"][i] == "open"]
                    if cut and len(same) < sum(z != "boiler" for z in r["zones"]):
                        ids.append(r["page_id"])
                        hashes.append(r["hash"])
                        cuts.append(cut)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(cuts, pa.list_(pa.int32()))],
                                             names=["__id", "__hash", "cut"])

    found = pairs.mapInArrow(align, "__id long, __hash long, cut array<int>")
    return found.groupBy("__id", "__hash").agg(F.min("cut").alias("cut"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: page_id, url, text, n_chars."""
    common.arrow_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    u = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^.*?://[^/?#]*([^?#]*)", 1)
    keys = common.materialize(shared_lines(rows.select("page_id", F.xxhash64("html").alias("hash"), host.alias("host"),
                                                       path.alias("path"), "html")))
    rest, found = common.split_rows(rows, keys, "page_id", "html")

    def scan(batches):
        for batch in batches:
            cuts = batch.column(3)
            text = [main_text(t.as_py(), set(c.as_py() or ())) for t, c in zip(batch.column(2), cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())],
                                             names=["page_id", "url", "text"])

    both = rest.withColumn("cut", F.lit(None).cast("array<int>")).unionByName(found.select("page_id", "url", "html", "cut"))
    got = both.mapInArrow(scan, "page_id long, url string, text string")
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@common.register("op2_html_extraction")
def op2(spark, sf):
    return extract(common.table(spark, sf, "pages"))

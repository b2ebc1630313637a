"""Main text of web pages by deduction of each host's template from equivalence classes of tokens.

A page is a sequence of tokens: start tags, each told apart by the path of elements that it stands in, and blocks of text. The occurrence
vector of a token holds how often each page of the host has it; it is kept as the exclusive or of one hash for each (page, count), so that
equal vectors have equal sketches and are added up on the map side. Tokens with equal vectors are one equivalence class. A class is valid
if it is large (CLASS_SIZE tags and more), frequent (half of the pages) and occurs at most once in a page. Classes nest by
their paths. Pages with equal tokens count once, so copies of an article do not become a template.

The template leaves slots: the elements of valid classes with what is in them. The main slot is the innermost one that holds more than
half of the host's slot text outside of menus, adverts and the like; the slots that hold more than half are a chain, so it is
unique. Blocks of text that every page of a host has at the same path outside of the host's main slot are part of the template and go,
whatever the number of pages; blocks inside of it stay. They matter on pages that lack the slot. The rest is extracted.
Hosts without a valid class use the template deduced from all pages together.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

CLASS_SIZE = 3
LEAST_PAGES = 3
#: Tokens in all templates together, up to which they are broadcast (32 bytes each); beyond, pages move to them in SALTS parts a host.
BROADCAST_TOKENS = 500_000
SALTS = 32
ALL_HOSTS = "*"

#: Elements of HTML by what they are here.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote caption figcaption".split()) | INLINE
ASIDE = frozenset("head nav footer aside form svg math button select object canvas dialog menu audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPE = frozenset("html body article main section div table ul ol dl td th blockquote aside nav footer header form".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
COMMENT_WORDS = frozenset(("comment", "comments", "disqus"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def beside(name: str, attrs: dict[str, str]) -> bool:
    """Whether an element is known to stand beside the main text, by its name, class, id or role."""
    if name in ASIDE:
        return True
    if name in ("html", "body", "main"):
        return False
    if attrs.get("role", "").lower() in ASIDE_ROLES:
        return True
    found = COMMENT_WORDS if name == "article" else ASIDE_WORDS
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = re.split(r"[-_]+", token)
        if parts[0] in found or (parts[-1] in found and not {"with", "has", "no", "without"} & set(parts)):
            return True
    return False


class Page:
    """A parsed page: elements (role, parent element, stop) and blocks of text (element, text), both in page order.

    An element's role is a hash of its path of names and classes; -1 as parent is the page itself. stop: elements that cannot be the
    main slot, as they are themselves blocks of text or stand beside it.
    """

    def __init__(self, source: str | None) -> None:
        self.roles: list[int] = []
        self.parents: list[int] = []
        self.depths: list[int] = []
        self.stop: list[bool] = []
        self.header: list[bool] = []
        self.aside: list[bool] = []
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int, str]] = []
        run: list[str] = []
        source = source or ""

        def flush() -> None:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                at = next((i for n, i, _ in reversed(stack) if n not in INLINE), -1)
                self.blocks.append((at, text))

        def close(names: set[str]) -> None:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in names:
                    flush()
                    del stack[k:]
                    return
                if stack[k][0] in SCOPE:
                    return

        last = 0
        for m in _TOKEN.finditer(source):
            run.append(source[last : m.start()])
            last = m.end()
            name = (m["name"] or "").lower()
            if not name:
                if m["raw"]:
                    flush()
                continue
            if name not in INLINE:
                flush()
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        flush() if any(n not in INLINE for n, _, _ in stack[k:]) else None
                        del stack[k:]
                        break
                continue
            if name in CLOSE_P:
                close({"p"})
            if name in CLOSES:
                close(CLOSES[name])
            if name in VOID:
                continue
            attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(m["attrs"] or "")}
            parent, path = (stack[-1][1], stack[-1][2]) if stack else (-1, "")
            mark = name + "".join(f".{c}" for c in sorted(attrs.get("class", "").split()))
            path = f"{_hash(path)}/{mark}"
            away = beside(name, attrs) or (parent >= 0 and self.aside[parent])
            self.roles.append(_hash(path))
            self.parents.append(parent)
            self.depths.append(len(stack))
            self.stop.append(away or name in BLOCKS or name == "header")
            self.header.append(name == "header" or (parent >= 0 and self.header[parent]))
            self.aside.append(away)
            stack.append((name, len(self.roles) - 1, path))
        run.append(source[last:])
        flush()

    def tokens(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """(token, count, depth or -1, slot characters in it) of every distinct token; depth is -1 for texts and for elements that stop."""
        count: Counter[int] = Counter(self.roles)
        chars: Counter[int] = Counter()
        depth = {r: -1 if s else d for r, d, s in zip(self.roles, self.depths, self.stop, strict=True)}
        for at, text in self.blocks:
            if at >= 0 and not self.aside[at] and not self.header[at]:
                up = at
                while up >= 0:
                    chars[self.roles[up]] += len(text)
                    up = self.parents[up]
            token = self.placed(at, text)
            count[token] += 1
            depth[token] = -2
        keys = list(count)
        return keys, [count[k] for k in keys], [depth[k] for k in keys], [chars[k] for k in keys]

    def placed(self, at: int, text: str) -> int:
        """A block's token: its text and the path of the element that it stands in."""
        return _hash(f"text {self.roles[at] if at >= 0 else ''} {text}")

    def inside(self, at: int, role: int | None) -> bool:
        while at >= 0:
            if self.roles[at] == role:
                return True
            at = self.parents[at]
        return False

    def main_text(self, slots: list[int], constants: set[int]) -> str:
        """Text of the main slot; slots: roles from the innermost outwards, of which the first that the page has once counts."""
        found = Counter(self.roles)
        slot = next((r for r in slots if found[r] == 1), None)
        root = self.roles.index(slot) if slot is not None else -1
        out = []
        for at, text in self.blocks:
            if (at >= 0 and self.aside[at]) or (constants and self.placed(at, text) in constants and not self.inside(at, slots[0] if slots else None)):
                continue
            up = at
            while up not in (root, -1):
                up = self.parents[up]
            # a header inside of the main slot belongs to the article; one outside, or with no slot found, is the page's
            if up == root and (root >= 0 or at < 0 or not self.header[at]):
                out.append(text)
        return " ".join(out)


def host(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


def page_tokens(df: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, sig, tokens array<struct<t, n, depth, chars>>) of the pages; sig is a hash of all tokens."""
    small_batches(df.sparkSession)
    kind = pa.list_(pa.struct([("t", pa.int64()), ("n", pa.int32()), ("depth", pa.int32()), ("chars", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, found = [], []
            for text in b.column(1).to_pylist():
                rows = sorted(zip(*Page(text).tokens(), strict=True))
                sigs.append(_hash(repr(rows)))
                found.append([{"t": t, "n": n, "depth": d, "chars": c} for t, n, d, c in rows])
            yield pa.RecordBatch.from_pydict({"host": b.column(0), "sig": pa.array(sigs, pa.int64()), "tokens": pa.array(found, kind)})

    return df.select(host(url).alias("host"), F.coalesce(F.col(source), F.lit("")).alias("html")).mapInArrow(run, "host string, sig long, tokens array<struct<t:long,n:int,depth:int,chars:long>>")


def deduce_templates(df: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, slots, constants): slots are roles from the innermost outwards; the host ALL_HOSTS stands for all pages together."""
    pages = materialize(page_tokens(df, url, source).dropDuplicates(["host", "sig"]), "page-tokens")
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    sizes = sizes.unionByName(sizes.agg(F.lit(ALL_HOSTS).alias("host"), F.sum("pages").alias("pages")))
    rows = pages.select("host", "sig", F.explode("tokens").alias("e")).select("host", "sig", "e.*")
    # texts count for their own host only; tags for all hosts together too
    rows = rows.select(F.explode(F.when(F.col("depth") > -2, F.array("host", F.lit(ALL_HOSTS))).otherwise(F.array("host"))).alias("host"), "sig", "t", "n", "depth", "chars")
    vectors = rows.groupBy("host", "t").agg(
        F.count(F.lit(1)).alias("held"), F.max("n").alias("most"), F.expr("bit_xor(xxhash64(sig, n))").alias("vector"), F.max("depth").alias("depth"), F.sum("chars").alias("chars")
    )
    vectors = vectors.where(f"most = 1 and held >= {LEAST_PAGES}").join(sizes, "host").where("2 * held >= pages")
    vectors = materialize(vectors, "vectors")
    classes = vectors.where("depth > -2").groupBy("host", "vector").agg(F.count(F.lit(1)).alias("size")).where(f"size >= {CLASS_SIZE}")
    tags = vectors.where("depth > -1").join(classes, ["host", "vector"])
    total = tags.groupBy("host").agg(F.max("chars").alias("total"))
    slots = tags.join(total, "host").where("2 * chars > total").groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "t"))).alias("s"))
    constants = vectors.where("depth = -2 and held = pages").groupBy("host").agg(F.collect_list("t").alias("constants"))
    return slots.join(constants, "host", "left").select("host", F.transform("s", lambda x: x["t"]).alias("slots"), F.coalesce("constants", F.array().cast("array<long>")).alias("constants"))


def extract_main_text(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text) of every row. A null html counts as empty and gives an empty text; pages with a null url are one host.

    Repeated rows are extracted alike and change no template. Other columns are dropped.
    """
    spark = df.sparkSession
    templates = materialize(deduce_templates(df, url, source), "templates")
    general = templates.where(F.col("host") == ALL_HOSTS).select("slots").first()  # one row
    rest = [int(x) for x in general["slots"]] if general else []
    size = templates.agg(F.sum(F.size("slots") + F.size("constants")), F.count(F.lit(1))).first()
    base = df.select(F.col(key), F.col(url), F.col(source).alias("html"), host(url).alias("_host"))
    found = templates.select(F.col("host").alias("_of"), "slots", "constants")
    if (size[0] or 0) + size[1] <= BROADCAST_TOKENS:
        joined = base.join(F.broadcast(found), F.col("_host") == F.col("_of"), "left")
    else:
        base = base.withColumn("_salt", F.pmod(F.xxhash64("html", key), F.lit(SALTS)).cast("int"))
        found = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.join(found.hint("merge"), (F.col("_host") == F.col("_of")) & (F.col("_salt") == F.col("_part")), "left")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(h).main_text(s or rest, set(c or ())) for h, s, c in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_pydict({key: b.column(0), url: b.column(1), "text": pa.array(texts, pa.string())})

    kinds = f"{key} {df.schema[key].dataType.simpleString()}, {url} {df.schema[url].dataType.simpleString()}, text string"
    return joined.select(key, url, "html", "slots", "constants").mapInArrow(run, kinds)


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

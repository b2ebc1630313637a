"""Line deduplication by a segment-partition edit join, in DataFrame and SQL functions only.

A line is its text without white space at both ends. Lines of LEAST characters and more are near if at most THRESHOLD edits part them.
Each line is split into THRESHOLD + 1 segments of even length; if another line is near, one segment is left whole in it, at a place that
the edits before and after it can have moved it to. So a line is indexed by (its length, segment number, segment) and probes, for every
length up to THRESHOLD shorter than its own, the substrings of its own at the places that a segment can have moved to. Pairs that meet
are verified by a bit-parallel edit automaton in a band: one 64-bit word holds, for each number of edits, which of the 2 * THRESHOLD + 1
diagonals can be reached, and takes one step for each character between the parts that both lines begin and end with.

Longer lines have more room: lines of WORDS_AN_EDIT words and more are near also if at most one word in WORDS_AN_EDIT of the shorter one,
MOST_WORDS at most, has to be replaced, put in or left out. The same segments, places and automaton serve for this, over words in place of
characters; lines of each number of edits have keys of their own. Words are what spaces part. Lines that have four segments of words need
none of characters: two edits of characters spoil three of them at most, and move the words of the rest by one for each space.

Most lines are near no other, so these keys are made only for lines that share a coarse key with another. Coarse keys are few: their parts follow
the length in steps of STEP, and lines that are near have at least one in common.

Keys that several lines have are buckets. A bucket is compared inside of one row; one of more than BLOCK lines is cut into blocks and
compared block pair by block pair, so no row holds more than two blocks. A pair counts at the smallest key that it shares only, and from
each block pair only sums and one edge for each linked line go on, so no pairs are gathered.

Equal lines are one node, whatever their number; classes are connected components of the links, and the first line of a class by
(document, text's hash, place) is kept. Shorter lines are nodes like the others, alike only if they are equal: two edits would be most of
them. Blank lines and lines of documents without an id are in no class and always kept. Lines are told apart by 62 bits of a hash. Rows of
one id with different texts are rows of their own; rows that repeat another whole have its lines and its results. An empty table gives no
rows; lines of any length are compared whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, materialize, table

THRESHOLD = 2
LEAST = 24
WORDS_AN_EDIT = 20
MOST_WORDS = 3
#: Lines of one bucket that are compared in one row, against as many others.
BLOCK = 64
#: Lengths, in characters or words, whose coarse keys are cut alike.
STEP = 8
WHITE = " \t\x0b\f\r"
#: Letters that stand for words, by a hash, and the most words of a line that are compared by them: that takes time by their square.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-"
CODED = 1024
#: Characters that two lines have between their common ends, up to which the built-in distance is taken; it takes time by their square too.
SHORT = 256


def split_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, body, line_no from 0, line, h): the lines that are not blank; body and h are hashes of the whole text and of the line."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # what is taken from a whole text is taken before it is split, so once and not for each line
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(whole).alias("body"), F.split(whole, "\n", -1).alias("all"))
    lines = texts.select("doc", "body", F.posexplode("all").alias("line_no", "line"))
    # most lines have no white space at their ends, and to look for it costs less than to trim
    ends = reduce(Column.__or__, [F.startswith("line", F.lit(c)) | F.endswith("line", F.lit(c)) for c in WHITE])
    lines = lines.withColumn("line", F.when(ends, F.trim("line", F.lit(WHITE))).otherwise(F.col("line"))).where("line <> ''")
    return lines.withColumn("h", F.shiftrightunsigned(F.xxhash64("line"), 2))


def places(i: int, less: int, tau: int) -> range:
    """By how many characters segment i of a line `less` shorter can have moved, seen from both ends."""
    return range(max(-i, less - (tau - i)), min(i, less + (tau - i)) + 1)


def key_specs(tau: int, words: bool) -> list[tuple[int, ...]]:
    """(class, parts, segment, less, move, probe) of every key of a line; a line's own index keys meet those of lines as long."""
    seed = -tau if words else 0
    index = [(seed, tau + 1, i, 0, 0, 0) for i in range(tau + 1)]
    return index + [(seed, tau + 1, i, less, move, 1) for i in range(tau + 1) for less in range(tau + 1) for move in places(i, less, tau) if less or move]


def listed(names: str, specs: list[tuple[int, ...]]) -> str:
    """SQL: an array of structs."""
    return f"array({', '.join(f"struct({', '.join(f'{x} as {n}' for x, n in zip(spec, names.split(), strict=True))})" for spec in specs)})"


def coarse_keys(lines: DataFrame, tau: int = THRESHOLD) -> DataFrame:
    """(k, h): keys of lines (h, line, n, ws, nw), of which two lines that are near have at least one in common, for tau up to 2.

    The parts for a pair are cut for the step of the shorter line's length, so a line has keys for its own step and, if a shorter line of a pair can
    be in it, the step before. Two parts are the line's start and end. If both differ, each has had an edit, and of two edits none is left: what is
    between is whole and has moved by one place at most, so of its parts at two neighbouring places one is also in the other line.
    Lines of WORDS_AN_EDIT words and more are cut by words. An edit of a character changes one word, or parts or joins two: a word left out between two parts
    keeps it from spoiling both. Three edits of words can leave one for the middle, which has two parts then, one placed from the start, one from the
    end: one of them has no edit in it, nor on its side but the one that spoiled the start or the end.
    """
    most, low = max(tau, MOST_WORDS), WORDS_AN_EDIT

    def specs(by_words: int, long: int, back: int) -> list[tuple[int, ...]]:
        parts = [(0, 0), (1, 0), *[(part, shift) for part in (2, 3)[: 1 + long] for shift in (0, 1)]]
        return [(by_words, long, back, *p) for p in parts]

    def listing(*kinds: tuple[int, int, int]) -> str:
        return listed("by_words long back part shift", [s for kind in kinds for s in specs(*kind)])

    # a step that has lines of three edits is long
    first_long = next(b for b in range(low, low * MOST_WORDS + 1, STEP) if b + STEP > low * MOST_WORDS)
    chars = f"if(n >= {LEAST + STEP} and (n - {LEAST}) % {STEP} < {tau}, {listing((0, 0, 0), (0, 0, tau))}, {listing((0, 0, 0))})"
    two = f"nw >= {low + STEP} and (nw - {low}) % {STEP} < {most}"
    by_words = f"if({two}, case when nw < {first_long} then {listing((1, 0, 0), (1, 0, most))} when nw < {first_long + STEP} then {listing((1, 1, 0), (1, 0, most))} else {listing((1, 1, 0), (1, 1, most))} end, if(nw < {first_long}, {listing((1, 0, 0))}, {listing((1, 1, 0))}))"
    # lines of a few words more than WORDS_AN_EDIT can be near shorter ones, by characters
    choice = f"case when nw < {low} then {chars} when nw < {low + tau} then {listing((0, 0, 0), (0, 0, tau), (1, 0, 0))} else {by_words} end"
    rows = lines.select("h", "line", "n", "ws", "nw", F.explode(F.expr(choice)).alias("s")).select("h", "line", "ws", "s.*", F.expr("if(s.by_words = 1, nw, n)").alias("len"))
    rows = rows.withColumn("b", F.expr(f"cast(if(by_words = 1, {low} + (len - back - {low}) div {STEP} * {STEP}, {LEAST} + (len - back - {LEAST}) div {STEP} * {STEP}) as int)"))
    rows = rows.withColumn("a", F.expr("cast(if(long = 1, (b - 5) div 4, (b - 2 * by_words) div 3) as int)")).withColumn("m", F.expr("if(long = 1, a, b - 2 * a - 1 - 2 * by_words)"))
    start, size = "case part when 0 then 1 when 1 then len - a + 1 when 2 then a + 1 + by_words + shift else len - a - m - shift end", "if(part < 2, a, m)"
    return rows.select(F.expr(f"shiftrightunsigned(if(by_words = 1, xxhash64(1, b, part, slice(ws, {start}, {size})), xxhash64(0, b, part, substr(line, {start}, {size}))), 16)").alias("k"), "h")


def line_keys(lines: DataFrame, tau: int = THRESHOLD) -> DataFrame:
    """(k, h, probe): index keys and probe keys of lines (h, line, n, ws, nw); ws holds the words of a line of many words.

    Keys of all kinds are made by one expression over a list of what
    to take, so that compiled methods stay small.
    """
    chars, by_words = key_specs(tau, False), {t: key_specs(t, True) for t in range(1, MOST_WORDS + 1)}
    # a line is in the classes of all numbers of word edits that it can share with a line as short or shorter
    bounds = sorted({0} | {WORDS_AN_EDIT * t for t in by_words} | {WORDS_AN_EDIT * (t + 1) + t for t in by_words if t < MOST_WORDS} | {WORDS_AN_EDIT * MOST_WORDS + tau})
    choice = "case"
    for low in reversed(bounds):  # from the top down; the first bound that a line reaches decides
        parts = [s for t, s in by_words.items() if low >= WORDS_AN_EDIT * t and (t == MOST_WORDS or low < WORDS_AN_EDIT * (t + 1) + t)]
        if low < WORDS_AN_EDIT * MOST_WORDS + tau or tau >= MOST_WORDS:
            parts.insert(0, chars)
        choice += f" when nw >= {low} then {listed("seed parts i less move probe", [s for p in parts for s in p])}"
    rows = lines.select("h", "line", "n", "ws", "nw", F.explode(F.expr(f"{choice} end")).alias("s")).select("h", "line", "n", "ws", "nw", "s.*")
    rows = rows.withColumn("len", F.expr("if(seed < 0, nw, n) - less"))
    base, over = "(len div parts)", "(len - len div parts * parts)"
    start = f"cast({base} * i + greatest({over} - (parts - i), 0) + move + 1 as int)"
    size = f"cast({base} + if({over} >= parts - i, 1, 0) as int)"
    return rows.select(F.expr(f"if(seed < 0, xxhash64(seed, len, i, slice(ws, {start}, {size})), xxhash64(seed, len, i, substr(line, {start}, {size})))").alias("k"), "h", "probe")


def let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value that is taken once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def within(a: str, b: str, tau: int) -> str:
    """SQL: whether two arrays, neither of them empty, are within tau edits of their elements. Registers of 2 * tau + 1 bits, one for each number of edits, share a word.

    Bit d of a register stands for place j + d - tau in b after j elements of a. A step keeps the diagonals on which the next
    elements match, and from the register of one edit less takes the same diagonal (substitution), the one below (an element of a
    too many) and, from its new value, the one above (an element of b too many).
    """
    if tau > 4:
        raise ValueError("registers for more than 4 edits do not fit into a 64-bit word")
    width = 2 * tau + 1
    gap = width + 1  # a spare bit keeps registers apart
    full = (1 << width) - 1
    match = " | ".join(f"if(get({b}, j + {d - tau - 1}) = get({a}, j - 1), {1 << d}L, 0L)" for d in range(width))
    spread = " | ".join(f"shiftleft(m, {gap * e})" for e in range(tau + 1))
    keep = sum(full << gap * e for e in range(tau + 1))
    step = f"((r & ({spread})) | shiftleft(r, {gap}) | shiftright(shiftleft(r, {gap}), 1)) & {keep}L"
    for e in range(1, tau + 1):
        step = let("x", step, f"(x | (shiftleft(x & {full << gap * (e - 1)}L, {gap + 1}) & {full << gap * e}L))")
    first = sum((((1 << (e + 1)) - 1) << tau & full) << gap * e for e in range(tau + 1))
    ends = " | ".join(f"shiftleft(1L, {gap * e} + size({b}) - size({a}) + {tau})" for e in range(tau + 1))
    return f"(abs(size({a}) - size({b})) <= {tau} and (aggregate(sequence(1, size({a})), {first}L, (r, j) -> if(r = 0L, 0L, {let('m', match, step)})) & ({ends})) <> 0)"


def near(x: str, y: str, tau: int = THRESHOLD) -> str:
    """SQL: whether two lines, structs with line and nw, are near. What they begin and end with alike is left out first; of words, whole ones only."""
    steps = "array(4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1)"
    least = "least(length(c.a), length(c.b))"
    begin = f"aggregate({steps}, 0, (p, s) -> if(p + s <= {least} and substr(c.a, p + 1, s) = substr(c.b, p + 1, s), p + s, p))"
    end = f"aggregate({steps}, 0, (q, s) -> if(q + s <= {least} - p0 and substr(c.a, length(c.a) - q - s + 1, s) = substr(c.b, length(c.b) - q - s + 1, s), q + s, q))"

    def rest(of: str, p: str, q: str) -> str:
        return f"substr({of}, {p} + 1, length({of}) - {p} - {q})"

    apart = let("e", "struct(split(d.a, '') as a, split(d.b, '') as b)", within("e.a", "e.b", tau))
    chars = let("d", f"struct({rest('c.a', 'p0', 'q0')} as a, {rest('c.b', 'p0', 'q0')} as b)", f"if(d.a = '' or d.b = '' or length(d.a) <= {SHORT}, levenshtein(d.a, d.b, {tau}) >= 0, {apart})")
    # the common start up to its last space, the common end from its first
    p1 = "if(p0 = 0, 0, p0 - length(substring_index(substr(c.a, 1, p0), ' ', -1)))"
    q1 = "if(q0 = 0, 0, q0 - length(substring_index(substr(c.a, length(c.a) - q0 + 1, q0), ' ', 1)))"
    pieces = f"struct(split(trim({rest('c.a', 'w.p', 'w.q')}), ' +') as a, split(trim({rest('c.b', 'w.p', 'w.q')}), ' +') as b)"
    by_words = " ".join(f"when c.t = {t} then {within('e.a', 'e.b', t)}" for t in range(1, MOST_WORDS + 1))
    count = "size(filter(e.a, z -> z <> '')) + size(filter(e.b, z -> z <> '')) <= c.t"
    words = let("w", f"struct({p1} as p, {q1} as q)", let("e", pieces, f"if(get(e.a, 0) = '' or get(e.b, 0) = '', {count}, case {by_words} else false end)"))
    both = f"((c.t > 0 and {words}) or (abs(length(c.a) - length(c.b)) <= {tau} and {chars}))"
    return let("c", f"struct({x}.line as a, {y}.line as b, least({MOST_WORDS}, least({x}.nw, {y}.nw) div {WORDS_AN_EDIT}) as t)", let("p0", begin, let("q0", end, both)))


def coded(line: str) -> str:
    """SQL: a letter for each word of a line. Letters of two lines are no farther apart than their words."""
    return f"array_join(transform(array_remove(split({line}, ' '), ''), z -> substr('{LETTERS}', cast(pmod(xxhash64(z), {len(LETTERS)}) as int) + 1, 1)), '')"


def may_be_near(x: str, y: str, tau: int = THRESHOLD) -> str:
    """SQL: false only if two lines, structs with line, nw and code, are not near. An edit of a character changes two words at most, as it may part one or join two."""
    t = f"least({MOST_WORDS}, least({x}.nw, {y}.nw) div {WORDS_AN_EDIT})"
    apart = f"if(greatest({x}.nw, {y}.nw) > {CODED}, 0, levenshtein({x}.code, {y}.code, {max(2 * tau, MOST_WORDS)}))"
    return let("g", apart, f"(g >= 0 and (g <= {t} or abs(length({x}.line) - length({y}.line)) <= {tau}))")


def parted(lines: DataFrame) -> DataFrame:
    """(h, line, n, ws, nw) of lines (h, line): n is the length; ws, the words, and nw, their number, are for lines of many words, else nw is 0."""
    # words are parted once, and only in lines that are long enough to have many
    parts = lines.select("h", "line", F.length("line").alias("n")).withColumn("all", F.when(F.col("n") >= 2 * WORDS_AN_EDIT - 1, F.split("line", " ")))
    parts = parts.withColumn("ws", F.when(F.contains("line", F.lit("  ")), F.array_remove("all", "")).otherwise(F.col("all"))).drop("all")
    many = F.coalesce(F.size("ws"), F.lit(0))
    return parts.withColumn("nw", F.when(many >= WORDS_AN_EDIT, many).otherwise(0))


def line_links(lines: DataFrame, tau: int = THRESHOLD) -> DataFrame:
    """(h, links, label) of lines (h, line) that are near others, in parts: links add up to the number of different lines that are near
    h, and the (h, label) connect what is linked. Lines are of LEAST characters and more.

    Keys move once. Those that no other line has go at once, by their smallest and largest line.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = lines.where(F.length("line") >= LEAST).select("h", "line").repartition(parts, "h")
    if tau <= 2:
        coarse = coarse_keys(parted(distinct.distinct()), tau).repartition(parts, "k")
        met = coarse.groupBy("k").agg(F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y").select("k")
        some = coarse.join(met.hint("shuffle_hash"), "k").select("h").distinct()
        # not a semi-join, which would go below the repartition, so that lines would move twice
        distinct = distinct.join(some.hint("shuffle_hash"), "h")
    stored = materialize(distinct.distinct(), "lines")
    # a column that may be null gets a filter in one of two uses of the keys, so that keys would be made twice
    distinct = stored.select(F.coalesce("h", F.lit(0)).alias("h"), "line")
    marked = parted(distinct)
    # 48 bits of a key are enough, as lines that meet by chance are compared too; their zeros at a row's end cost nothing when it is compressed
    rows = line_keys(marked, tau).select((F.col("h") * 2 + F.col("probe")).alias("v"), F.shiftrightunsigned("k", 16).alias("k")).repartition(parts, "k")
    met = rows.groupBy("k").agg(F.min("v").alias("x"), F.max("v").alias("y"), F.min(F.col("v") % 2).alias("p"), F.count(F.lit(1)).alias("size")).where("p = 0 and shiftright(x, 1) <> shiftright(y, 1)").select("k", "size")
    both = rows.join(met.hint("shuffle_hash"), "k").select("k", F.shiftright("v", 1).alias("h"), (F.col("v") % 2).alias("probe"), "size")
    own = both.groupBy("h").agg(*[F.sort_array(F.collect_set(F.when(F.col("probe") == p, F.col("k")))).alias(n) for p, n in enumerate(("idx", "prb"))], F.collect_set(F.struct("k", "size")).alias("at"))
    texts = own.hint("merge").join(distinct, "h")
    dealt = texts.select("h", "line", F.expr(coded("line")).alias("code"), "idx", "prb", F.explode("at").alias("e")).select("h", "line", "code", F.length("code").alias("nw"), "idx", "prb", "e.k", F.ceil(F.col("e.size") / BLOCK).cast("int").alias("blocks"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # of a member's keys, a bucket needs those that come before its own
    below = [F.expr(f"filter({c}, z -> z < k)").alias(c) for c in ("idx", "prb")]
    dealt = dealt.select("k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.struct("h", "own", "line", "nw", "code", F.array_contains("idx", F.col("k")).alias("at"), *below).alias("m"))
    # little data and much to compute, so it is dealt to many tasks by hand
    rooms = dealt.repartition(4 * parts, "k", "lo", "hi").groupBy("k", "lo", "hi").agg(F.collect_list("m").alias("m")).where("size(m) > 1")
    met_before = "(arrays_overlap(x.idx, y.idx) or arrays_overlap(x.idx, y.prb) or arrays_overlap(x.prb, y.idx))"
    wanted = let("x", "m[p.i]", let("y", "m[p.j]", f"((lo = hi or x.own <> y.own) and (x.at or y.at) and not {met_before} and {may_be_near('x', 'y', tau)} and {near('x', 'y', tau)})"))
    every = "flatten(transform(sequence(0, size(m) - 2), i -> transform(sequence(i + 1, size(m) - 1), j -> struct(i as i, j as j))))"
    merged = let("u", "l[p.i]", let("v", "l[p.j]", "if(u = v, l, transform(l, z -> if(z = u or z = v, least(u, v), z)))"))
    labels = f"aggregate(e, transform(m, x -> x.h), (l, p) -> {merged})"
    out = let("e", f"filter({every}, p -> {wanted})", f"if(size(e) = 0, null, {let('l', labels, 'transform(sequence(0, size(m) - 1), i -> struct(m[i].h as h, size(filter(e, p -> p.i = i or p.j = i)) as links, l[i] as label))')})")
    found = rooms.select(F.explode(F.expr(out)).alias("e")).select("e.*")
    links = materialize(found.where("links > 0 or label <> h"), "line-links")
    discard(stored)
    return links


def line_classes(df: DataFrame, key: str = "doc_id", text: str = "text", tau: int = THRESHOLD) -> DataFrame:
    """(doc, body, line_no, n_links, class_doc, class_line, kept) of every line that is not blank.

    n_links: other different lines that are near. A class is named by its first line's document and place; only that line is kept.
    """
    lines = split_lines(df, key, text)
    links = line_links(lines.select("h", "line"), tau)
    joined = components(links.select(F.col("h").alias("a"), F.col("label").alias("b"))).select(F.col("node").alias("h"), F.col("component").alias("class"))
    placed = materialize(lines.select("doc", "body", "line_no", "h"), "placed")
    # one row for each different line from here on: its first place, then its class's
    first = placed.groupBy("h").agg(F.min(F.struct("doc", "body", "line_no")).alias("first"))
    nodes = materialize(links.groupBy("h").agg(F.sum("links").alias("n_links")).join(joined, "h"), "nodes")
    of_class = first.join(nodes, "h").groupBy("class").agg(F.min("first").alias("of_class"))
    linked = nodes.join(of_class, "class").select("h", "n_links", "of_class")
    known = first.join(linked, "h", "left").select("h", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("of_class", "first").alias("c"))
    out = placed.join(known, "h").select("doc", "body", "line_no", "n_links", F.col("c.doc").alias("class_doc"), F.col("c.line_no").alias("class_line"), F.col("c.body").alias("class_body"))
    kept = (F.col("doc") == F.col("class_doc")) & (F.col("body") == F.col("class_body")) & (F.col("line_no") == F.col("class_line"))
    return out.withColumn("kept", kept).drop("class_body")


def remove_duplicate_lines(df: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", tau: int = THRESHOLD) -> DataFrame:
    """df without the lines that are not kept; the length column, if there is one, follows a text that changes. All rows stay, as do columns of any name."""
    gone = line_classes(df, key, text, tau).where(~F.col("kept")).groupBy("doc", "body").agg(F.collect_set("line_no").alias("gone"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"))
    joined = rows.join(gone, (rows["row"][key] == gone["doc"]) & (rows["mark"] == gone["body"]), "left")
    old = F.col("row")[text]
    left = F.array_join(F.filter(F.split(old, "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    new = F.when(F.col("gone").isNull(), old).otherwise(left)
    return joined.select(*[new.alias(c) if c == text else F.when(F.col("gone").isNull(), F.col("row")[c]).otherwise(F.length(left).cast(df.schema[c].dataType)).alias(c) if c == length else F.col("row")[c].alias(c) for c in df.columns])


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "n_links", F.col("class_doc").alias("class_doc_id"), F.col("class_line").cast("long").alias("class_line_no"), "kept")

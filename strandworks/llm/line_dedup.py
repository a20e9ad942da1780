"""Line dedup by a segment-partition edit join (Pass-Join), in DataFrame operations only.

Distinct lines are the rows of the join. A line of length l is cut into TAU + 1 segments; a line
within TAU edits must contain one of them at nearly its place, so it probes the segment index with
the few substrings that the multi-match-aware bounds leave, for each length from its own down to TAU
less. A first pass finds the keys that two lines share, by the least and the largest id of each; a
second keeps the rows of those keys, a small part of all. Two lines within TAU edits differ by at most
2 * TAU in the sum of their characters' counts, and that test inside the join keeps lines which merely
share a passage from becoming pairs.

Lines of one template (log lines, dated headings) share their segments with all others of it. A key of
more than HOT lines therefore makes no pairs: what the lines of its group have in common at both ends
is cut off, or else the matched segment, and the rest, which is within TAU edits where the lines are,
is cut into segments again inside the group, until lists are short. Texts of less than CUT characters
are too short for segments and meet in what is left of them without up to TAU characters.

What is left is verified with the banded bit-parallel edit distance: one word holds the band's vertical
differences, so a column costs the same for any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandworks.llm.common import ID_ROWS, free_name, materialize, release, small_join, table

#: Most edits between linked lines, and how many characters of the shorter line there must be for each.
TAU, PER_EDIT = 2, 3
#: Texts of so many characters are cut into segments.
CUT = 6
#: Lines of a key of which all pairs are tried.
HOT = 512
#: Broadcast limit of the table of shared keys, one integer column: some 60 MB as a hash table.
KEY_ROWS = 1_500_000
#: Characters that are counted, six to a word, ten bits each.
LETTERS = (" etaon", "isrhdl", "ucmfwy", "pgbvk,", "012345", "6789.:")


def letter_counts(line: str, letters: str) -> Column:
    """Counts of some letters, each at most 1023, in one word."""
    each = f"transform(array({', '.join(repr(c) for c in letters)}), c -> cast(least(1023, length({line}) - length(replace({line}, c, ''))) as bigint))"
    return F.expr(f"aggregate({each}, 0L, (w, n) -> shiftleft(w, 10) | n)")


def _apart(a: str, b: str) -> str:
    """Sum of the differences of packed counts."""
    return " + ".join(f"abs((shiftright({a}, {10 * k}) & 1023) - (shiftright({b}, {10 * k}) & 1023))" for k in range(6))


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(d, i, s): what a line looks up: segment i of a line that is d shorter, moved by s. With i segments
    before it and tau - i behind, a match leaves at most i edits there and tau - i here. The segments of
    the line itself, with which it is indexed, are among them: those with d = s = 0."""
    return [
        (d, i, s)
        for d in range(tau + 1)
        for i in range(tau + 1)
        for s in range(-tau, tau + 1)
        if max(-i, d - (tau - i)) <= s <= min(i, d + (tau - i))
    ]


def _specs(length: int, tau: int, whole: bool) -> list[tuple[int, int, int, int]]:
    """(t, d, i, s): the probes of a text of ``length`` characters for texts of at least CUT, cut for t edits."""
    out = []
    for d in range(min(tau, length - CUT) + 1):
        t = min(tau, (length - d) // PER_EDIT) if whole else tau
        out += [(t, *p) for p in probes(t) if p[0] == d]
    return out


def _without(text: str, n: int) -> str:
    """The text without up to n of its characters, as SQL: an array of different strings."""
    one = "if(length(x) = 0, array(), transform(sequence(1, length(x)), i -> concat(substring(x, 1, i - 1), substring(x, i + 1))))"
    return f"aggregate(sequence(1, {n}), array({text}), (all, k) -> array_distinct(concat(all, flatten(transform(all, x -> {one})))))"


def keyed(texts: DataFrame, tau: int, *, whole: bool = True) -> DataFrame:
    """(id, key, own, tiny, at, size) and the columns of ``texts``: a row for every probe of every text.

    own: the probe is a segment of the text itself, the one with which it is indexed. The key hashes
    (group, length, segment, part), or, for a text too short for segments (tiny), what is left of it.
    texts: (id, text) of whole lines, or (group, id, text) of what is left of them (not ``whole``), which
    are cut for tau edits whatever their length.
    """
    as_array = lambda specs: "array(" + ", ".join(f"named_struct('t', {t}, 'd', {d}, 'i', {i}, 's', {s}, 'v', cast(null as string))" for t, d, i, s in specs) + ")"
    # a text of n characters meets those that are shorter than CUT
    edits, least = (min(tau, (CUT - 1) // PER_EDIT), PER_EDIT) if whole else (tau, 0)
    short = f"transform({_without('text', edits)}, v -> named_struct('t', 0, 'd', 0, 'i', 0, 's', 0, 'v', v))"
    top = max(CUT, PER_EDIT * tau) + tau
    q = " ".join(f"when len = {n} then {as_array(_specs(n, tau, whole))}" for n in range(CUT, top))
    q = f"case when len >= {top} then {as_array(_specs(top, tau, whole))} {q} else array() end"
    q = f"if(len >= {CUT + edits}, {q}, concat({q}, if(len >= {least}, {short}, array())))"
    bytes_ = F.expr("if(octet_length(text) = length(text), cast(text as binary), null)")
    df = texts.select("*", F.length("text").alias("len"), bytes_.alias("bytes")).select("*", F.explode(F.expr(q)).alias("q"))
    # the segments of a length are even parts, the longer ones last
    part, longer = "((len - q.d) div (q.t + 1))", "((len - q.d) % (q.t + 1))"
    at = f"cast(q.i * {part} + greatest(0, q.i - (q.t + 1 - {longer})) + 1 + q.s as int)"
    size = f"cast({part} + if(q.i >= q.t + 1 - {longer}, 1, 0) as int)"
    # where characters are bytes, a part is cut out of the bytes without counting characters; the hash
    # is of the bytes either way
    group = "" if whole else "group, "
    key = f"if(q.v is not null, xxhash64({group}-1, 0, cast(q.v as binary)), xxhash64({group}len - q.d, q.i, if(bytes is null, cast(substring(text, {at}, {size}) as binary), substring(bytes, {at}, {size}))))"
    own = "q.v is not null or q.d = 0 and q.s = 0"
    return df.select(*texts.columns, F.expr(key).alias("key"), F.expr(own).alias("own"), F.expr("q.v is not null").alias("tiny"), F.expr(at).alias("at"), F.expr(size).alias("size"))


def _common(x: str, y: str) -> str:
    """Characters that two strings share from their start."""
    steps = "array(65536, 32768, 16384, 8192, 4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1)"
    grow = f"array_repeat(65536, cast(least(length({x}), length({y})) div 65536 as int))"
    return f"aggregate(concat({grow}, {steps}), 0, (p, s) -> if(p + s <= least(length({x}), length({y})) and substring({x}, p + 1, s) = substring({y}, p + 1, s), p + s, p))"


def _possible(tau: int) -> str:
    """Whether two texts c.x, c.y (the shorter first) with different ends can be within tau edits: of two
    edits one is at the first and one at the last character, so all between is equal."""
    m, k = "length(c.x)", "length(c.y)"
    if tau > 2:
        return f"{k} - {m} <= {tau}"
    if tau < 2:
        return f"{k} <= 1"
    return (
        f"{k} <= 2 or {m} = {k} and (substring(c.x, 2, {m} - 2) = substring(c.y, 2, {m} - 2) or substring(c.x, 2) = substring(c.y, 1, {m} - 1) or substring(c.x, 1, {m} - 1) = substring(c.y, 2))"
        f" or {k} = {m} + 1 and (substring(c.x, 2) = substring(c.y, 2, {m} - 1) or substring(c.x, 1, {m} - 1) = substring(c.y, 2, {m} - 1)) or {k} = {m} + 2 and c.x = substring(c.y, 2, {m})"
    )


def banded_distance(a: str, b: str, tau: int) -> Column:
    """Edit distance of two string columns, exact up to ``tau`` (above it: some number above tau).

    Bit k of a word stands for row j - tau + k in column j. The score follows the band's lowest
    diagonal to the last row, then that row. Equal ends are cut off first; if that leaves one text empty
    or one character of each, the distance is plain, and what cannot be within tau edits for its ends is
    left out. A common tail of tau characters lets the band reach the last row.
    """
    ones, top = (1 << (2 * tau + 1)) - 1, 2 * tau
    tail = "~" * tau
    pm = " | ".join(f"if(coalesce(get(s.p, j - {tau} + {k} - 1) = get(s.t, j - 1), false) and j - {tau} + {k} >= 1, {1 << k}, 0)" for k in range(2 * tau + 1))
    body = f"""
      aggregate(sequence(1, size(s.t)), named_struct('vp', {ones ^ ((1 << tau) - 1)}, 'vn', 0, 'd', {tau}),
        (v, j) -> aggregate(array({pm}), v, (w, x) ->
          aggregate(array(((((x & w.vp) + w.vp) ^ w.vp) | x | w.vn) & {ones}), w, (u, d0) -> named_struct(
            'vp', ((d0 & u.vp) | ({ones} ^ (shiftright(d0, 1) | ((u.vn | ({ones} ^ (d0 | u.vp))) & {ones})))) & {ones},
            'vn', shiftright(d0, 1) & (u.vn | ({ones} ^ (d0 | u.vp))) & {ones},
            'd', u.d + if(j + {tau} <= size(s.p), if(d0 & {1 << top} = 0, 1, 0),
                   if((u.vn | ({ones} ^ (d0 | u.vp))) & shiftleft(1, greatest(0, size(s.p) - j + {tau})) <> 0, 1, 0)
                   - if(d0 & u.vp & shiftleft(1, greatest(0, size(s.p) - j + {tau})) <> 0, 1, 0))))),
        v -> v.d)"""
    cut = f"transform(array({_common(a, b)}), h -> named_struct('a', substring({a}, h + 1), 'b', substring({b}, h + 1)))[0]"
    rev = f"transform(array({cut}), x -> named_struct('a', reverse(x.a), 'b', reverse(x.b)))[0]"
    core = f"transform(array({rev}), x -> transform(array({_common('x.a', 'x.b')}), h -> named_struct('a', substring(x.a, h + 1), 'b', substring(x.b, h + 1)))[0])"
    core = f"transform({core}, c -> if(length(c.a) <= length(c.b), named_struct('x', c.a, 'y', c.b), named_struct('x', c.b, 'y', c.a)))"
    band = f"transform(array(named_struct('p', split(concat(c.x, '{tail}'), ''), 't', split(concat(c.y, '{tail}'), ''))), s -> {body})[0]"
    return F.expr(f"transform({core}, c -> if(length(c.x) = 0 or length(c.y) = 1, length(c.y), if({_possible(tau)}, {band}, {tau + 1})))[0]")


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, no, line): the lines that hold a word, numbered from 0, without white space at their ends."""
    return (
        docs.select(docs[key].alias("doc"), F.posexplode(F.split(docs[text], "\n")).alias("no", "line"))
        # trimming a set of characters walks the whole line, so only lines that need it
        .withColumn("line", F.expr("if(ascii(line) <= 32 or ascii(right(line, 1)) <= 32, trim(both ' \t\r\x0b\x0c' from line), line)"))
        .where("line <> ''")
    )


def _pairs(rows: DataFrame, counts: DataFrame, tau: int) -> DataFrame:
    """(a, b): lines that share a key of rows, one of them by a segment of its own, with like counts."""
    names = [c for c in counts.columns if c != "id"]
    rows = rows.join(counts, "id")
    x, y = rows.where("own").alias("x"), rows.alias("y")
    # the first word, of the most frequent characters, tells most pairs apart
    first = _apart(f"x.{names[0]}", f"y.{names[0]}")
    apart = " + ".join(_apart(f"x.{c}", f"y.{c}") for c in names)
    if "parts" in rows.columns:
        # a list that cannot be cut again is dealt over tasks: the index once, the probes to every part
        x = rows.where("own").withColumn("part", F.expr("cast(pmod(xxhash64(id), parts) as int)")).alias("x")
        y = rows.withColumn("part", F.explode(F.expr("sequence(0, cast(parts as int) - 1)"))).alias("y")
    same = "x.key = y.key and x.part = y.part" if "parts" in rows.columns else "x.key = y.key"
    found = y.join(x, F.expr(f"{same} and x.id <> y.id and ({first}) <= {2 * tau} and ({apart}) <= {2 * tau}"))
    return found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _rest(hot: DataFrame) -> DataFrame:
    """(group, id, text): what is left of the texts of each long list, to be cut again.

    hot: (key, group, id, text, at, size). The group's common start and end go where that is a quarter of
    its longest text; equal ends make groups one, as they mostly hold the same lines. Else the matched
    segment goes.
    """
    ends = hot.groupBy("key").agg(
        F.min("text").alias("lo"), F.max("text").alias("hi"), F.min(F.reverse("text")).alias("rlo"), F.max(F.reverse("text")).alias("rhi"),
        F.min(F.length("text")).alias("least"), F.max(F.length("text")).alias("most"),
    ).withColumn("p", F.expr(_common("lo", "hi")))
    ends = ends.withColumn("s", F.least(F.expr(_common("rlo", "rhi")), F.col("least") - F.col("p")))
    ends = ends.withColumn("trim", F.expr("4 * (p + s) >= most")).withColumn("ends", F.expr("xxhash64(substring(lo, 1, p), substring(rlo, 1, s))"))
    df = hot.join(ends.select("key", "p", "s", "trim", "ends"), "key")
    group = F.when(F.col("trim"), F.xxhash64("group", "ends")).otherwise(F.col("key"))
    text = F.when(F.col("trim"), F.expr("substring(text, p + 1, length(text) - p - s)")).otherwise(F.expr("concat(substring(text, 1, at - 1), substring(text, at + size))"))
    return df.select(group.alias("group"), "id", text.alias("text")).distinct()


def edit_join(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """Links (a, b), a < b, between different lines within ``tau`` edits, and within one for every
    PER_EDIT characters of the shorter line. lines: (id, line), where rows of one id have one text; ids
    may repeat and have any type that can be ordered. ``lines`` is read three times."""
    lines = lines.select("id", F.col("line").alias("text")).where(F.length("line") >= PER_EDIT)
    # whole lines: the keys of different lines first
    by_hash = lines.select(F.xxhash64("id").alias("id"), "text")
    keys = keyed(by_hash, tau).groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    keys = materialize(keys, "lines-keys")
    rows = small_join(keyed(lines, tau).select("id", "key", "own", "tiny"), keys, ["key"], "left_semi", limit=KEY_ROWS)
    rows = materialize(rows.groupBy("id", "key").agg(F.max("own").alias("own"), F.max("tiny").alias("tiny")), "lines-rows")
    wanted = materialize(rows.select("id").distinct(), "lines-ids")
    texts = small_join(lines, wanted, ["id"], "left_semi", limit=ID_ROWS).groupBy("id").agg(F.first("text").alias("text"))
    texts = materialize(texts.select("id", "text", *[letter_counts("text", x).alias(f"c{k}") for k, x in enumerate(LETTERS)]), "lines-texts")
    counts = texts.drop("text")
    pairs, left = None, None
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("tiny").alias("tiny")).where(f"n > {HOT}")
        sizes = materialize(sizes, "lines-sizes")
        usual = small_join(rows, sizes.select("key"), ["key"], "left_anti", limit=KEY_ROWS)
        found = _pairs(usual, counts, tau)
        some = {r.tiny for r in sizes.select("tiny").distinct().collect()}
        if True in some:
            long_ = sizes.where("tiny").select("key", F.expr(f"n div {HOT} + 1").alias("parts"))
            found = found.union(_pairs(small_join(rows, long_, ["key"], "inner"), counts, tau))
        found = materialize(found, "lines-pairs")
        pairs = found if pairs is None else pairs.union(found)
        if False not in some:
            break
        # long lists of longer texts: cut what is left of them again, each inside its group
        hot = sizes.where("not tiny").select("key")
        if left is None:
            ids = materialize(small_join(rows, hot, ["key"], "left_semi", limit=KEY_ROWS).select("id").distinct(), "lines-hot")
            source = keyed(small_join(texts.select("id", "text"), ids, ["id"], "left_semi", limit=ID_ROWS), tau).withColumn("group", F.lit(0).cast("long"))
        else:
            source = keyed(left, tau, whole=False)
        left = materialize(_rest(materialize(small_join(source, hot, ["key"], "left_semi", limit=KEY_ROWS), "lines-long")), "lines-left")
        every = materialize(keyed(left, tau, whole=False).groupBy("id", "key").agg(F.max("own").alias("own"), F.max("tiny").alias("tiny")), "lines-every")
        shared = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        rows = materialize(every.join(shared, "key", "left_semi"), "lines-rows")
        release(every)
    pairs = pairs.distinct()
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("la")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("lb")), "b")
    limit = F.least(F.lit(tau), F.expr(f"least(length(la), length(lb)) div {PER_EDIT}"))
    return materialize(both.where(banded_distance("la", "lb", tau) <= limit).select("a", "b"), "lines-links")


def line_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", tau: int = TAU) -> DataFrame:
    """One row per key: n_lines, n_dropped, n_links, dropped_lines.

    A line is dropped if its text, or a text within ``tau`` edits and one edit for every PER_EDIT
    characters of the shorter one, first occurs before it (by key, then line number): so lines of one or
    two characters are dropped only for equal ones. n_links sums, over the document's lines, the
    different texts so near. White space at a line's ends does not count, lines without a word are no
    lines; a null text has none. Keys are integers (rows that share one are treated as one document, whose
    dropped_lines are the numbers dropped in any of them); a null key is a key of its own, first in order.
    Texts are told apart by two 64-bit hashes. A very long line is one row of few keys. An empty table
    gives an empty result.
    """
    base = docs.select(docs[key].cast("long").alias("__k"), docs[text].alias("__t"))
    keys = base.select("__k").distinct()
    hashes = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")]
    rows = lines_of(base, "__k", "__t").select("doc", "no", "line", *hashes)
    narrow = materialize(rows.select("doc", "no", "h1", "h2"), "lines")
    texts = narrow.groupBy("h1", "h2").agg(F.min(F.struct("doc", "no")).alias("at"), F.count("*").alias("copies"))
    texts = materialize(texts.withColumn("id", F.struct("h1", "h2")), "lines-distinct")
    links = edit_join(rows.select(F.struct("h1", "h2").alias("id"), "line"), tau)
    ends = links.union(links.select("b", "a")).toDF("id", "other")
    # first places of the linked lines
    linked = materialize(ends.select("id").distinct(), "lines-linked")
    at = materialize(small_join(texts.select("id", "at"), linked, ["id"], "left_semi", limit=ID_ROWS), "lines-places")
    per = ends.join(at.toDF("other", "other_at"), "other").join(at, "id").groupBy("id").agg(
        F.count("*").alias("links"), F.max(F.col("other_at") < F.col("at")).alias("late")
    )
    notable = texts.select("h1", "h2", "id", "at", "copies").join(per, "id", "left").where("copies > 1 or links > 0").select("h1", "h2", "at", "links", "late")
    notable = materialize(notable, "lines-notable")
    judged = small_join(narrow, notable, ["h1", "h2"])
    dropped = F.coalesce(F.col("late"), F.lit(False)) | F.coalesce(F.col("at") < F.struct("doc", "no"), F.lit(False))
    out = judged.withColumn("dropped", dropped).groupBy("doc").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.col("dropped").cast("long")).alias("n_dropped"),
        F.sum(F.coalesce("links", F.lit(0))).alias("n_links"),
        # a set, so that rows of one key make no longer list than the longest of them
        F.sort_array(F.collect_set(F.when(F.col("dropped"), F.col("no")))).alias("dropped_lines"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return keys.join(out, F.expr("__k <=> doc"), "left").select(
        F.col("__k").alias("doc_id"), zero("n_lines"), zero("n_dropped"), zero("n_links"),
        F.coalesce("dropped_lines", F.expr("cast(array() as array<int>)")).alias("dropped_lines"),
    )


def without_dropped(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the dropped lines cut out of their texts. Rows with a null key or text stay as
    they are; repeated rows of a key lose the same lines; an empty table stays empty."""
    own = free_name(docs, "__d")
    cut = found.where("n_dropped > 0").select(F.col("doc_id").alias(key), F.col("dropped_lines").alias(own))
    kept = F.expr(f"array_join(filter(split(`{text}`, '\\n'), (x, i) -> not array_contains({own}, i)), '\\n')")
    return docs.join(cut, key, "left").withColumn(text, F.when(F.col(own).isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)


def op7_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that repeat an earlier line up to two edits; dropped_lines joined by commas."""
    found = line_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("dropped_lines", F.array_join("dropped_lines", ","))


#: Two edits at most: where equal ends are cut off, one is at the first and one at the last character.
OP7_SQL = f"""
WITH w AS (SELECT doc_id, no, regexp_replace(l, '^[ \\t\\r\\x0B\\x0C]+|[ \\t\\r\\x0B\\x0C]+$', '', 'g') AS l FROM
       (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents)),
o AS (SELECT w.*, row_number() OVER (ORDER BY doc_id, no) AS place FROM w WHERE l <> ''),
t AS (SELECT *, length(replace(l, 'e', '')) AS e, length(replace(l, ' ', '')) AS s, length(replace(l, 'n', '')) AS n
      FROM (SELECT l, length(l) AS z, min(place) AS place FROM o GROUP BY l)),
p AS (SELECT x.l AS a, y.l AS b, x.z AS za, y.z AS zb, least({TAU}, x.z // {PER_EDIT}) AS lim FROM t x JOIN t y
      ON y.z BETWEEN x.z AND x.z + {TAU} AND (x.z < y.z OR x.l < y.l) AND abs(x.e - y.e) <= {TAU} AND abs(x.s - y.s) <= {TAU} AND abs(x.n - y.n) <= {TAU}
      WHERE levenshtein(x.l, y.l) <= {4 * TAU}),
h AS (SELECT *, coalesce(list_min(list_filter(range(1, za + 1), lambda i: a[i] <> b[i])) - 1, za) AS h FROM p),
u AS (SELECT a, b, lim, a[h + 1:] AS ca, b[h + 1:] AS cb FROM h),
v AS (SELECT *, reverse(ca) AS ra, reverse(cb) AS rb FROM u),
g AS (SELECT *, coalesce(list_min(list_filter(range(1, length(ca) + 1), lambda i: ra[i] <> rb[i])) - 1, length(ca)) AS g FROM v),
c AS (SELECT a, b, lim, reverse(ra[g + 1:]) AS x, reverse(rb[g + 1:]) AS y, length(ca) - g AS m, length(cb) - g AS k FROM g),
k AS (SELECT a, b FROM c WHERE k <= 1 AND lim >= 1 OR lim >= 2 AND (k <= 2
      OR m = k AND (x[2:m - 1] = y[2:m - 1] OR x[2:] = y[:m - 1] OR x[:m - 1] = y[2:])
      OR k = m + 1 AND (x[2:] = y[2:k - 1] OR x[:m - 1] = y[2:k - 1]) OR k = m + 2 AND x = y[2:k - 1])),
both_ AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
per AS (SELECT x.l, count(*) AS links, min(y.place) AS first FROM both_ JOIN t x ON x.l = a JOIN t y ON y.l = b GROUP BY x.l),
j AS (SELECT o.doc_id, o.no, coalesce(per.links, 0) AS links, t.place < o.place OR coalesce(per.first < t.place, FALSE) AS dropped FROM o JOIN t USING (l) LEFT JOIN per USING (l))
SELECT d.doc_id, count(j.no)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped, coalesce(sum(links), 0)::BIGINT AS n_links,
       coalesce(string_agg(j.no::VARCHAR, ',' ORDER BY j.no) FILTER (WHERE dropped), '') AS dropped_lines
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id
"""

"""MinHash near-duplicates from bottom-k sketches of one hash function.

1.  Every text becomes the set of hashes of its 5-word shingles; the least SKETCH of them are its
    sketch. Texts with equal sets form a class, and only classes are compared.
2.  Inverted lists of retained values. Linked texts share at least NEED values of their sketches (the
    mean less six standard deviations at the threshold), so it is enough to index, rarest first, the
    values up to one more than may be missing; values of one class alone use up that allowance, and
    most texts drop out here.
3.  Lists of at most LIST classes give all their pairs, longer ones the pairs with their most central
    class. The Jaccard estimate of the union's sketch filters the pairs, the full sets confirm them.
4.  Where a longer list still holds several components, its classes are compared exactly: the same
    rarest-first index over their full sets, with the bounds on size and on shared shingles that the
    threshold implies, and only between components; no estimate filters these pairs. So no list is
    capped, and a large group of copies costs pairs in proportion to its size, unless its texts really
    are that close but not linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandworks.llm.arrow_map import append_columns
from strandworks.llm.common import ID_ROWS, materialize, release, small_join, table
from strandworks.llm.components import components

#: Words in a shingle; least Jaccard similarity of linked texts, in %.
SHINGLE, PERCENT = 5, 85
SKETCH, NEED = 48, 26
#: Sets of at most so many shingles are kept whole instead of a sketch.
WHOLE = 60
#: Classes in an inverted list of which all pairs are made.
LIST = 24
#: Values of a full set's prefix that a row of the exact index carries at most.
PREFIX = 64
#: Pairs of short lists and of central classes whose estimate is lower are not verified; the cut is that of the index.
ESTIMATE = NEED / SKETCH

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS: dict[bytes, int] = {}
_MANY = 1 << 18


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's shingles; of fewer words, one of the whole sequence."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    if len(_WORDS) > _MANY:
        _WORDS.clear()
    for w in set(words).difference(_WORDS):
        _WORDS[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    x = np.full(n, width, np.uint64)
    for k in range(width):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unique((x >> np.uint64(1)).astype(np.int64))


def _measure(texts: list) -> dict:
    out: dict[str, list] = {"n": [], "s1": [], "s2": [], "sketch": []}
    for t in texts:
        s = shingles(t)
        d = xxhash.xxh3_128_digest(s.tobytes())
        out["n"].append(len(s))
        out["s1"].append(int.from_bytes(d[:8], "little", signed=True))
        out["s2"].append(int.from_bytes(d[8:], "little", signed=True))
        out["sketch"].append(s if len(s) <= WHOLE else s[:SKETCH])
    return out


MEASURED = [T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))]


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. texts: (class, text) of all classes in pairs."""
    both = (
        pairs.select("a", "b")
        .join(texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", "ta", "tb")
    )

    def check(batches):
        last, own = None, None
        for batch in batches:
            a, b, ok = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, k in enumerate(a):
                if k != last:
                    last, own = k, shingles(batch.column(2)[i].as_py())
                other = shingles(batch.column(3)[i].as_py())
                both_ = len(np.intersect1d(own, other, assume_unique=True))
                ok.append(100 * both_ >= PERCENT * (len(own) + len(other) - both_))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, o in zip(a, ok, strict=True) if o], pa.int64()), pa.array([x for x, o in zip(b, ok, strict=True) if o], pa.int64())], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, several: bool) -> DataFrame:
    """(class, text as bytes): a row of each wanted class. several: an id may have other texts than its class's."""
    ids = wanted.select("class", F.col("class").alias("__id"))
    if several:
        ids = materialize(wanted.select("class").join(classes.select("class", F.col("least").alias("__id")), "class"), "minhash-ids")
    texts = small_join(docs.select("__id", F.col("__text").cast("binary").alias("text")), ids, ["__id"], "inner", limit=ID_ROWS)
    if several:
        texts = append_columns(texts, "text", MEASURED, _measure).where(_name() == F.col("class"))
    return texts.select("class", "text").dropDuplicates(["class"])


def _name():
    """Name of a class where ids have several texts: then two classes may have the same least id."""
    return F.xxhash64("s1", "s2")


def _pairs_of(index: DataFrame, extra: str = "") -> DataFrame:
    """All pairs of classes in a list whose sizes allow the threshold."""
    x, y = index.alias("x"), index.alias("y")
    joined = x.join(y, F.expr(f"x.value = y.value and x.class < y.class and 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n) {extra}"))
    return joined.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for every input row.

    key must be an integer. Texts without words (and null texts) have no shingles and are linked with
    nothing; rows with a null key are kept, with a null component. Rows that share key and text share
    their result; of rows that share a key but not a text, each is judged by its own text, and the
    component of the key is that of all of them. An empty table gives an empty result.
    """
    docs = docs.select(docs[key].cast("long").alias("__id"), docs[text].alias("__text"))
    made = materialize(append_columns(docs, "__text", MEASURED, _measure).select("__id", "n", "s1", "s2", "sketch"), "minhash-docs")
    links, classes, several = _links(docs, made)
    comp = materialize(components(links), "minhash-components")
    if several:
        first = comp.join(classes.select(F.col("class").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
        comp = materialize(comp.join(first, "component").select("node", F.col("first").alias("component")), "minhash-named")
    # classes of more than one document, or in a component of another
    moved = classes.select("class", "least", "s1", "s2", "copies").join(comp.withColumnRenamed("node", "class"), "class", "left")
    moved = moved.withColumn("component", F.coalesce("component", "least")).where("copies > 1 or component <> least")
    moved = materialize(moved.select("s1", "s2", "component"), "minhash-moved")
    out = small_join(made.drop("sketch"), moved, ["s1", "s2"])
    component = F.when((F.col("n") > 0) & F.col("__id").isNotNull(), F.coalesce("component", "__id")).otherwise(F.col("__id"))
    return out.select(F.col("__id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _links(docs: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(links between classes, the classes, whether an id has several texts). A class is named by its least id if not."""
    keyed = made.where("__id is not null").groupBy("__id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("__id")
    keyed = materialize(keyed, "minhash-keys")
    several = keyed.limit(1).count() > 0
    classes = made.where("n > 0 and __id is not null").groupBy("s1", "s2").agg(
        F.min("__id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    classes = materialize(classes.withColumn("class", _name() if several else F.col("least")), "minhash-classes")
    post = classes.select("class", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    df = post.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    live = post.join(df, "value").groupBy("class", "n", "s").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    need = F.when(F.col("n") <= 50, F.ceil(F.col("n") * PERCENT / 100)).otherwise(F.lit(NEED))
    live = live.withColumn("left", (F.col("s") - need + 1 - (F.col("s") - F.size("v"))).cast("int")).where("left > 0")
    index = live.select("class", "n", (F.col("s") - F.size("v")).alias("alone"), F.explode(F.expr("slice(v, 1, greatest(left, 0))")).alias("x")).select("class", "n", "alone", "x.value")
    index = materialize(index, "minhash-index")
    lists = index.groupBy("value").agg(F.count("*").alias("members"), F.min(F.struct(F.col("alone") / F.col("n"), "class", "n")).alias("c")).where("members > 1")
    lists = materialize(lists.select("value", "members", F.col("c.class").alias("center"), F.col("c.n").alias("center_n")), "minhash-lists")

    short = index.join(lists.where(f"members <= {LIST}").select("value"), "value", "left_semi")
    long_ = index.join(lists.where(f"members > {LIST}"), "value").where("class <> center")
    stars = long_.where(f"100 * least(n, center_n) >= {PERCENT} * greatest(n, center_n)").select(F.least("class", "center").alias("a"), F.greatest("class", "center").alias("b"))
    pairs = _pairs_of(short).union(stars).distinct()
    links = _verified(docs, classes, pairs, several, estimate=True)

    # longer lists that hold more than one component
    comp = materialize(components(links), "minhash-first")
    long_ = index.join(lists.where(f"members > {LIST}").select("value"), "value", "left_semi").join(comp.withColumnRenamed("node", "class"), "class", "left")
    long_ = materialize(long_.select("value", "class", F.coalesce("component", "class").alias("comp")), "minhash-long")
    mixed = long_.groupBy("value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("value")
    open_ = materialize(long_.join(mixed, "value", "left_semi").groupBy("class").agg(F.first("comp").alias("comp")), "minhash-open")
    if open_.limit(1).count():
        more = _verified(docs, classes, _exact_pairs(docs, classes, open_, several), several, estimate=False)
        links = links.union(more)
    # rows that share a key but not a text: their classes are linked by the key itself
    if several:
        same = small_join(made.where("n > 0"), keyed, ["__id"], "inner").select("__id", _name().alias("b")).distinct()
        same = materialize(same, "minhash-same")
        links = links.union(same.join(same.groupBy("__id").agg(F.min("b").alias("a")), "__id").where("a <> b").select("a", "b"))
    return links, classes, several


def _exact_pairs(docs: DataFrame, classes: DataFrame, open_: DataFrame, several: bool) -> DataFrame:
    """Pairs between components of the given classes that the full sets do not rule out."""
    texts = _texts(docs, classes, open_, several)
    full = append_columns(texts, "text", [T.StructField("set", T.ArrayType(T.LongType()))], lambda ts: {"set": [shingles(t) for t in ts]})
    full = materialize(full.select("class", F.size("set").alias("n"), F.explode("set").alias("value")), "minhash-full")
    df = full.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    live = full.join(df, "value").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    shared = F.size("v")
    live = live.withColumn("shared", shared).withColumn("left", F.expr(f"cast(n - ceil({PERCENT} * n / 100) + 1 - (n - size(v)) as int)")).where("left > 0")
    live = live.join(open_, "class")
    # A pair is made once, in the list of its first common value, where the values before it are known
    # not to be shared; prefixes beyond PREFIX values do without, and distinct() drops what they repeat.
    live = live.withColumn("v", F.expr("transform(slice(v, 1, greatest(left, 0)), x -> x.value)"))
    short = F.when(F.size("v") <= PREFIX, F.col("v"))
    index = live.select("class", "n", "shared", "comp", short.alias("v"), F.posexplode("v").alias("pos", "value"))
    index = materialize(index, "minhash-exact")
    bound = f"{100 + PERCENT} * if(x.v is null or y.v is null, least(x.shared, y.shared), least(x.shared - x.pos, y.shared - y.pos)) >= {PERCENT} * (x.n + y.n)"
    first = "(x.v is null or y.v is null or get(array_intersect(x.v, y.v), 0) = x.value)"
    return _pairs_of(index, f"and x.comp <> y.comp and {bound} and {first}").distinct()


def _likely(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sketches allow the threshold."""
    sk = classes.select("class", "n", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias("k"))
    both = pairs.join(sk.toDF("a", "na", "ka"), "a").join(sk.toDF("b", "nb", "kb"), "b")
    # of the union's sketch, how many values both hold; whole sets are compared whole
    size = F.when((F.col("na") <= WHOLE) & (F.col("nb") <= WHOLE), F.size(F.array_union("ka", "kb"))).otherwise(F.lit(SKETCH))
    union = F.slice(F.sort_array(F.array_union("ka", "kb")), F.lit(1), size)
    est = F.size(F.array_intersect(union, F.array_intersect("ka", "kb"))) / size
    return both.where(est >= ESTIMATE).select("a", "b")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, several: bool, estimate: bool) -> DataFrame:
    likely = pairs = materialize(pairs, "minhash-pairs")
    if estimate:
        likely = materialize(_likely(classes, pairs), "minhash-likely")
        release(pairs)
    wanted = materialize(likely.select(F.col("a").alias("class")).union(likely.select("b")).distinct(), "minhash-wanted")
    texts = materialize(_texts(docs, classes, wanted, several), "minhash-texts")
    links = materialize(_confirm(likely, texts), "minhash-links")
    release(texts)
    return links


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each component the one with the least key; repeated rows of it once."""
    found = near_duplicates(docs, key, text).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    found = materialize(found, "minhash-dropped")
    stay = small_join(docs, found, [key], "left_anti", limit=ID_ROWS)
    repeated = materialize(docs.where(docs[key].isNotNull()).groupBy(key).agg(F.count("*").alias("__c")).where("__c > 1").select(key), "minhash-repeated")
    if repeated.limit(1).count() == 0:
        return stay.select(*docs.columns)
    once = small_join(stay, repeated, [key], "left_semi").dropDuplicates([key])
    return small_join(stay, repeated, [key], "left_anti").unionByName(once).select(*docs.columns)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= {PERCENT} * (p.n + q.n - o)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT both_.b, r.root FROM r JOIN both_ ON both_.a = r.node AND r.root < both_.b)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""

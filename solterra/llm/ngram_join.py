"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are the distinct n-gram sets, columns the n-grams' 64-bit hashes, in one order that puts
frequent ones last. A pair whose similarity reaches the bound has so large a product that it must meet within the
first n - ceil(t n) + 1 columns of both rows (Bayardo et al. 2007), the prefixes. Columns in which a single
prefix stands bear no link and are dropped. What the rows have after their prefixes bounds what they can add there,
so a pair needs at least `need` products within the prefixes: it must meet `need` places before the end of what
is left of both prefixes, which rules out most rows of a frequent column by their sizes alone.

Components need no more than a spanning set of links. First each column's rows are multiplied with the one row of it
that has most columns in common with others, and rows found linked become one component. Then rows of different
components that meet are multiplied: pair by pair in columns where few rows are outside the largest component, else
block by block, where overlap counts are accumulated over slices of columns and only links that join components leave the task.

Before texts are fetched for a pair, the parities of both rows' columns in WIDTH classes are compared: two rows differ in at
least as many columns as classes whose parities differ, and similar rows in few, as their sizes say. That bound loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, free_name, lean, most_frequent
from .shingles import shingle_sets

#: Columns put last in the order, the most frequent ones: 16 bytes each in every task.
HOT = 1 << 16
#: A task reports a column that this many of its rows share.
REPORTED = 4
#: Parts into which a frequent column's rows, and the rows met by one row, are dealt.
SALTS = 16
#: Columns with more rows than this outside their largest component are multiplied in blocks; a block's rows and shingles.
FEW, BLOCK_ROWS, BLOCK_SHINGLES = 128, 1024, 1 << 20
#: Columns before a column in which rows that meet in it may have met already.
LOOK = 6
#: Places of texts, 24 bytes each, and rows' components, 16 bytes, that go to every task at most.
SENT = 1 << 20
#: Classes of columns whose parities a row's signature holds, one bit each.
WIDTH = 1024
#: Columns of a slice in a block's product.
SLICE = 4096


def _node(s: np.ndarray) -> int:
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def _batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


SET = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sig", pa.list_(pa.int64()))])
ENTRY = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("node", pa.int64()), ("pos", pa.int32())])
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _signature(s: np.ndarray) -> np.ndarray:
    """The parities of a set's hashes in WIDTH classes, as 64-bit integers."""
    odd = np.bincount((s & np.uint64(WIDTH - 1)).astype(np.int64), minlength=WIDTH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(n: int):
    """kind 0: a document, its set's size and hash, with the signature where it is met for the first time here;
    kind 1: doc_id is a frequent column and n its rows here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def frequent():
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            many = count >= REPORTED
            k = int(many.sum())
            return _batch(SET, np.ones(k, np.int32), keys[many].view(np.int64), pa.nulls(k), count[many], pa.nulls(k), pa.nulls(k))

        for batch in batches:
            sizes, nodes, sigs = [], [], []
            for s in shingle_sets(batch.column("text"), n):
                sizes.append(len(s))
                nodes.append(_node(s) if len(s) else None)
                sigs.append(None)
                if len(s) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    sigs[-1] = _signature(s)
                    held.append(s)
                    size += len(s)
                    if size > 1_500_000:
                        yield frequent()
                        held.clear()
                        seen.clear()
                        size = 0
            yield _batch(SET, np.zeros(len(sizes), np.int32), batch.column("doc_id"), batch.column("th"), sizes, nodes, sigs)
        if held:
            yield frequent()

    return lean(run, stateless=True)


def _prefixes(n: int, percent: int, hot: np.ndarray, rank: np.ndarray):
    """key, salt (0 for columns that are not hot), node, pos: the prefix of each distinct set met here."""
    maybe = np.zeros(1 << 22, bool)
    maybe[(hot >> np.uint64(42)).astype(np.int64)] = True

    def run(batches):
        seen: set[int] = set()

        def out(parts):
            return _batch(ENTRY, *(np.concatenate(c) for c in zip(*parts)))

        for batch in batches:
            parts, size = [], 0
            for s in shingle_sets(batch.column("text"), n):
                if not len(s) or (node := _node(s)) in seen:
                    continue
                seen.add(node)
                p = len(s) - -(-percent * len(s) // 100) + 1
                salt = np.zeros(len(s), np.int32)
                if (near := np.flatnonzero(maybe[(s >> np.uint64(42)).astype(np.int64)])).size:
                    at = np.minimum(np.searchsorted(hot, s[near]), len(hot) - 1)
                    r = np.zeros(len(s), np.int64)
                    r[near] = np.where(hot[at] == s[near], rank[at], 0)
                    order = np.lexsort((s, r))
                    s = s[order]
                    salt = np.where(r[order] > 0, 1 + node % SALTS, 0).astype(np.int32)
                parts.append((s[:p].view(np.int64), salt[:p], np.full(p, node), np.arange(p, dtype=np.int32)))
                size += p
                if size > 300_000:
                    yield out(parts)
                    parts, size = [], 0
            if parts:
                yield out(parts)
            if len(seen) > 200_000:
                seen.clear()

    return lean(run, stateless=True)


def _shared(batches):
    """From entries sorted by key, salt and node: each once, without those of a key that a single node has.

    Entries with a salt belong to a frequent key, whose other entries may lie elsewhere, and all stay.
    """
    last = None  # the last distinct entry, which waits for the next one's key
    waits = False
    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in ENTRY.names]
        if last is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(last, cols)]
        key, salt, node = cols[:3]
        if not len(key):
            continue
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])
        cols = [c[first] for c in cols]
        key, salt = cols[:2]
        given = last is not None and not waits
        near = salt > 0
        near[1:] |= key[1:] == key[:-1]
        near[:-1] |= key[1:] == key[:-1]
        waits = not (near[-1] or (given and len(key) == 1))
        out = near.copy()
        if given:
            out[0] = False
        last = [c[-1:] for c in cols]
        if out.any():
            yield _batch(ENTRY, *(c[out] for c in cols))


def _beside(n: int, percent: int):
    """Rows sorted by head and salt, the head first: the components of rows that are similar to the head's row.

    All rows of a batch are multiplied with their head at once.
    """

    def run(batches):
        at, head, own = None, np.zeros(0, np.uint64), None
        for batch in batches:
            ends, comps = [], []
            sets = shingle_sets(batch.column("text"), n)
            waiting: list[tuple[int, np.ndarray]] = []

            def multiply():
                if not waiting or not len(head):
                    waiting.clear()
                    return
                flat = np.concatenate([s for _, s in waiting])
                sizes = np.array([len(s) for _, s in waiting])
                hit = head[np.minimum(np.searchsorted(head, flat), len(head) - 1)] == flat
                both = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[hit], minlength=len(sizes))
                linked = 100 * both >= percent * (len(head) + sizes - both)
                ends.extend([own] * int(linked.sum()))
                comps.extend(c for (c, _), k in zip(waiting, linked) if k)
                waiting.clear()

            size = 0
            for a, salt, kind, comp, s in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "kind", "comp")), sets):
                if kind == 0 or size > 1_000_000:
                    multiply()
                    size = 0
                if kind == 0:
                    at, head, own = (a, salt), s, comp
                elif at == (a, salt) and len(s):
                    waiting.append((comp, s))
                    size += len(s)
            multiply()
            if ends:
                yield _batch(PAIR, ends, comps)

    return lean(run, stateless=True)


def _links(left: list, right: list, percent: int) -> list[tuple[int, int]]:
    """Links between rows (comp, set) of two blocks, or within one (right is left), as many as it takes to join what they join."""
    rows = left if right is left else left + right
    sizes = np.array([len(s) for _, s in rows])
    _, col, count = np.unique(np.concatenate([s for _, s in rows]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    use = count[col] > 1
    place = np.cumsum(count > 1) - 1
    row, col = row[use], place[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    k = len(left)
    overlap = np.zeros((k, len(rows)), np.float64)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, SLICE):
        a, b = np.searchsorted(col, (lo, lo + SLICE))
        part = np.zeros((len(rows), SLICE), np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        overlap += part[:k] @ part.T
    comp = np.unique([c for c, _ in rows], return_inverse=True)[1]
    linked = 100 * overlap >= percent * (sizes[:k, None] + sizes[None, :] - overlap)
    parent = np.arange(comp.max() + 1)
    out = []
    for i in range(k):
        for j in np.flatnonzero(linked[i] & (parent[comp] != parent[comp[i]])):
            x, y = parent[comp[i]], parent[comp[j]]
            if x != y:
                parent[parent == y] = x
                out.append((rows[i][0], rows[j][0]))
    return out


def _blocks(n: int, percent: int):
    """Rows sorted by key and pair of blocks (i, j), those of block i first: links between components in each."""

    def run(batches):
        at, sides = None, ([], [])

        def done():
            left, right = sides
            found = _links(left, left if at[1] == at[2] else right, percent) if left and (right or at[1] == at[2]) else []
            sides[0].clear(), sides[1].clear()
            return found

        for batch in batches:
            found = []
            for key, i, j, side, comp, s in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "comp")), shingle_sets(batch.column("text"), n)):
                if at != (key, i, j):
                    if at is not None:
                        found += done()
                    at = (key, i, j)
                sides[side].append((comp, s))
            if found:
                yield _batch(PAIR, *zip(*found))
        if at is not None and (found := done()):
            yield _batch(PAIR, *zip(*found))

    return lean(run, stateless=True)


def _multiply(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The components (a, b) of the pairs a, b, comp_a, comp_b that are similar.

    Each b's text travels once for each pair, each a's once for each salt.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    rows = salted.join(texts.hint("merge"), F.col("b") == F.col("node")).select("a", "salt", F.lit(1).alias("kind"), F.col("comp_b").alias("comp"), "text")
    heads = salted.select("a", "salt", "comp_a").distinct().join(texts.hint("merge"), F.col("a") == F.col("node")).select("a", "salt", F.lit(0).alias("kind"), F.col("comp_a").alias("comp"), "text")
    dealt = rows.unionByName(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return dealt.mapInArrow(_beside(n, percent), "a long, b long")


def _close(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures and sizes do not rule out that they are similar."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    heads = salted.select("a", "salt").distinct().join(signs.hint("merge"), F.col("a") == F.col("node")).select("a", "salt", F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    both = salted.join(heads.hint("merge"), ["a", "salt"]).join(signs.hint("merge"), F.col("b") == F.col("node"))
    differ = F.aggregate(F.zip_with("sig", "sig_a", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda k, x: k + x)
    return both.where(differ * (100 + percent) <= (F.col("n") + F.col("n_a")) * (100 - percent)).select(*pairs.columns)


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """node, comp (the smallest node of its component) for nodes that are no component's smallest.

    Alternating large and small stars (Kiveris et al. 2014); only minima are gathered for a node, never
    its neighbours, and each round is a written table.
    """
    e = tables.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = tables.written(small, "edges")
        before, state = state, tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _texts(docs: DataFrame, sets: DataFrame, nodes: DataFrame, tables: Tables) -> DataFrame:
    """node, text: a text of each of the nodes. Up to SENT places of texts go to every task, more are joined with a shuffle."""
    heads = sets.join(nodes.toDF("node").distinct().hint("merge"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("x"))
    heads = tables.written(heads.select("node", F.col("x.doc_id").alias("d"), F.col("x.th").alias("t")), "heads")
    heads = F.broadcast(heads) if heads.limit(SENT + 1).count() <= SENT else heads.hint("merge")
    texts = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("node", "text")
    return tables.written(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")


def _need(percent: int, m=None):
    """Column: products that rows of sizes n and m need within their prefixes, at least; falls as m goes away from n."""
    m = F.col("m") if m is None else m
    rest = F.greatest(*(F.ceil(c * percent / F.lit(100)) - 1 for c in (F.col("n"), m)))
    return F.ceil((F.col("n") + m) * percent / F.lit(100 + percent)) - rest


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, th, class for each row of docs(doc_id, text, ...).

    Words are runs without ASCII white space, A-Z in lower case; a text with fewer than n words is one
    shingle, one without words, or null, has none and stands alone. Rows link when 100 * intersection >= percent *
    union. component_id is the smallest doc_id that links reach; repeated doc_ids keep a row each, null
    doc_ids too (their component's smallest other doc_id, or null). th is the text's xxhash64,
    class a number of the component (null: no words). Other columns are ignored. Sets with the same 64-bit hash count as equal; among N distinct sets that goes wrong
    with a chance of about N^2 / 2^65.
    """
    tables = Tables(docs.sparkSession, "ngrams")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    made = tables.written(docs.mapInArrow(_sets(n), "kind int, doc_id long, th long, n long, node long, sig array<long>"), "sets")
    sets = made.where("kind = 0").select("doc_id", "th", "n", "node")
    signs = tables.written(made.where("sig IS NOT NULL").groupBy("node").agg(F.min("n").alias("n"), F.min("sig").alias("sig")), "signatures")
    often = tables.written(made.where("kind = 1").groupBy(F.col("doc_id").alias("key")).agg(F.sum("n").alias("df")), "frequent")
    rows = most_frequent(often, "df", HOT).collect()
    hot = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hot)
    rank = np.array([r["df"] for r in rows], np.int64)[order]

    entry = "key long, salt int, node long, pos int"
    entries = docs.select("text").mapInArrow(_prefixes(n, percent, hot[order], rank), entry)
    shared = entries.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").mapInArrow(lean(_shared, stateless=True), entry)
    # place among the row's shared columns, and their number; a row has as many as its prefix is long
    row = Window.partitionBy("node")
    placed = shared.join(signs.select("node", F.col("n").cast("int").alias("n")).hint("merge"), "node").select("key", "node", "n", (F.row_number().over(row.orderBy("pos")) - 1).alias("t"), F.count("*").over(row).cast("int").alias("s"))
    shared = tables.written(placed, "shared")

    fits = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    pivots = shared.groupBy("key").agg(F.max(F.struct("s", "node", "n")).alias("p")).select("key", F.col("p.node").alias("a"), F.col("p.n").alias("m"), F.col("p.s").alias("s_a"))
    pairs = shared.join(pivots.hint("merge"), "key").where((F.col("node") != F.col("a")) & fits & (F.least("s", "s_a") >= _need(percent)))
    pairs = tables.written(pairs.select("a", F.col("node").alias("b")).distinct().select("a", "b", F.col("a").alias("comp_a"), F.col("b").alias("comp_b")), "met")
    pairs = tables.written(_close(pairs, signs, percent), "pairs")
    texts = _texts(docs, sets, pairs.select("a").union(pairs.select("b")), tables)
    labels = components(_multiply(pairs, texts, n, percent), tables)
    tables.spent("met", "pairs", "heads", "texts")

    sent = labels.limit(SENT + 1).count() <= SENT
    x = shared.join(F.broadcast(labels) if sent else labels.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    x = tables.written(x.select("key", "node", "n", (F.col("s") - F.col("t")).cast("int").alias("left"), "comp"), "labelled")
    tables.spent("shared")
    # rows of which too little is left for any size that their column holds
    sizes = x.groupBy("key").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c"), F.max("comp").alias("d")).where("c <> d").select("key", "lo", "hi")
    x = x.join(sizes.hint("merge"), "key")
    least = [_need(percent, F.greatest("lo", F.ceil(F.col("n") * percent / F.lit(100)))), _need(percent, F.least("hi", F.floor(F.col("n") * 100 / F.lit(percent))))]
    # 1 less, as whole numbers do not fall evenly between
    x = tables.written(x.where(F.col("left") >= F.least(*least) - 1).drop("lo", "hi"), "able")
    tables.spent("labelled")
    of_comp = x.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    keys = of_comp.groupBy("key").agg(F.sum("k").alias("rows"), F.sum("size").alias("size"), F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("top")).where("comps > 1")
    x = tables.written(x.join(keys.select("key", "rows", "size", F.col("top.comp").alias("top"), (F.col("rows") - F.col("top.k")).alias("outside")).hint("merge"), "key"), "mixed")
    tables.spent("able")

    # one of two rows of different components is outside the column's largest one; rows that share a column
    # shortly before met there, with more of both left
    along = Window.partitionBy("node").orderBy(F.desc("left"))
    few = x.where(F.col("outside") <= FEW).withColumn("before", F.array_compact(F.array(*(F.lag("key", k).over(along) for k in range(1, LOOK + 1)))))
    few = tables.written(few, "few")
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("comp").alias("comp_b"), F.col("left").alias("left_b"), F.col("before").alias("before_b"), (F.col("comp") != F.col("top")).alias("out_b"))
    meet = (~F.col("out_b") | (F.col("node") < F.col("b"))) & (F.col("comp") != F.col("comp_b")) & fits & (F.least("left", "left_b") >= _need(percent)) & ~F.arrays_overlap("before", "before_b")
    pairs = few.where("comp <> top").join(other.hint("merge"), "key").where(meet).select(F.col("node").alias("a"), "b", F.col("comp").alias("comp_a"), "comp_b").distinct()
    met = tables.written(pairs, "met")
    tables.spent("few")
    pairs = tables.written(_close(met, signs, percent), "pairs")
    many = x.where(F.col("outside") > FEW)
    texts = _texts(docs, sets, pairs.select("a").union(pairs.select("b")).union(many.select("node")), tables)
    found = _multiply(pairs, texts, n, percent)

    many = many.withColumn("blocks", F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("size") / BLOCK_SHINGLES)).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side"), "node", "comp")
    many = many.join(texts.hint("merge"), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    found = found.unionByName(many.mapInArrow(_blocks(n, percent), "a long, b long"))
    joined = components(found, tables).select(F.col("node").alias("comp"), F.col("comp").alias("root"))

    full = sets.where("node IS NOT NULL").join(labels.hint("merge"), "node", "left").select("doc_id", "th", "n", F.coalesce("comp", "node").alias("comp"))
    full = full.join(joined.hint("merge"), "comp", "left").select("doc_id", "th", "n", F.coalesce("root", "comp").alias("comp"))
    smallest = full.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    full = full.join(smallest.hint("merge"), "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "th", F.col("comp").alias("class"))
    full = full.unionByName(sets.where("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "th", F.lit(None).cast("long").alias("class")))
    return tables.result(full, "components")


def distinct_documents(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, all columns of docs: the one with the smallest doc_id, at a tie the smallest hash of the text.

    Rows with a null doc_id stand for a component only if it has no other. Texts without words are in no component and stay.
    Of rows equal in doc_id and text one stays.
    """
    found = ngram_join(docs, n, percent)
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")
    best = found.where("class IS NOT NULL").groupBy("class").agg(F.min(place).alias("x")).select("x.doc_id", "x.th")
    d, t, id_, hash_ = (free_name(docs, c) for c in ("d", "t", "id", "hash"))
    best = best.unionByName(found.where("class IS NULL").select("doc_id", "th").distinct()).select(F.col("doc_id").alias(d), F.col("th").alias(t))
    rows = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(hash_, F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(best.hint("merge"), F.col(id_).eqNullSafe(F.col(d)) & (F.col(hash_) == F.col(t)), "left_semi")
    return rows.dropDuplicates([id_, hash_]).drop(id_, hash_)

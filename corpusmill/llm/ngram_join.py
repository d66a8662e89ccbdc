"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts are sets of word 5-grams; two texts are linked if their sets' Jaccard similarity is `threshold`
or more.

1. Equal texts are reduced to one.
2. Each text has a MinHash signature, laid out as `trees` prefix tries of `depth` values.
3. Prefixes are shortened from the whole depth in steps, down to the longest one at which a pair at the
   threshold meets in some trie with the target recall.  A text's leaf is the shortest prefix
   that at most `leaf` texts share; all pairs of a leaf are candidates.  In a trie node with more texts,
   every text is a candidate with the node's pivot.
4. What the forest leaves out is found by prefixes of the gram sets, which lose nothing: in any one order of all grams, two
   texts of n and m grams that are linked share one of the first n - ceil(threshold n) + 1 and m - ceil(threshold m) + 1.
   The order has grams of many texts last, so few texts share a first gram.  Texts that share one of few texts are candidates.
5. Texts that share first grams of many texts are families, the components over such grams, dealt into blocks of bounded
   size.  Each two blocks of a family are compared text by text within a task, on their grams; counts of links, and as many
   links as hold the classes together, leave it.  So a group of near copies isn't listed pair by pair.  The comparisons grow with the
   square of a family, as the number of links does that are counted.
6. Other candidates are verified on their 5-grams themselves.
7. Links make classes: connected components by propagation of the smallest label.

Defined results: a null text is a class of its own; a text of fewer than five words is one
gram of all its words; texts without words are linked to nothing, but equal ones are copies; copies, with any
doc_ids, share a class; the class id is its smallest doc_id, null last; an empty table gives an empty result;
extra columns are kept out of the join's result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import bounded_broadcast, fresh, small_batches, stored

GRAM = 5
LAST = (1 << 63) - 1
#: Texts with candidates up to this many (8 bytes each) are broadcast to pick them out of the documents.
MAX_BROADCAST_TEXTS = 2_000_000
#: Texts of families, up to this many (24 bytes each), are broadcast.
MAX_BROADCAST_CROWD = 1_000_000
#: Grams (8 bytes each) of a block of texts that are compared within a task, about so many; a longer text stays whole.
BLOCK_GRAMS = 1 << 17
#: A text counts as so many grams at least, so that a block of short ones holds few.
LEAST_GRAMS = 64
#: Pairs of blocks, and families of more than a block, up to this many (about 50 bytes each), are broadcast.
MAX_BROADCAST_BLOCKS = 300_000
#: Trie nodes with more texts than a leaf, up to this many (about 60 bytes each), are broadcast.
MAX_BROADCAST_NODES = 300_000
#: Grams of more texts than this (copies count) are frequent; more, if there are too many of them.
FEW = 16
#: Frequent grams go to all tasks, up to this many (16 bytes each).
MAX_FREQUENT = 2_000_000
#: Characters of text for each part that grams are dealt to, a few million grams.
PART_CHARS = 24_000_000
SEEDS = np.random.default_rng(10).integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def levels(trees: int, depth: int, threshold: float, recall: float, step: int = 2) -> list[int]:
    """Prefix lengths, shortest first: the longest that reaches the recall, and longer ones up to the depth."""
    short = next((k for k in range(depth, 0, -1) if 1 - (1 - threshold**k) ** trees >= recall), 1)
    return sorted({depth, *range(short, depth, step)})


def grams(step: rolling.Step) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word 5-grams of a step and the first gram of each row; a shorter row is one gram, an empty one none."""
    h = step.hashes(0)
    wide = rolling.window_hashes(h, GRAM)
    first, rows = step.windows(GRAM)
    out, at = [wide[first]], [rows]
    for n in range(1, GRAM):
        short = np.flatnonzero(step.n_words == n)
        if len(short):
            out.append(rolling.window_hashes(h, n)[step.row_words[:-1][short]])
            at.append(short)
    values, rows = np.concatenate(out), np.concatenate(at)
    order = np.argsort(rows, kind="stable")
    return values[order], np.searchsorted(rows[order], np.arange(step.n + 1))


def signature_batches(trees: int, lengths: list[int], depth: int):
    """The prefix hashes of each text that has a word, tree after tree."""

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            for step in rolling.steps(batch.column("text")):
                values, first = grams(step)
                rows = np.flatnonzero(np.diff(first))
                if not len(rows):
                    continue
                at = first[rows]
                out = np.empty((len(rows), trees * len(lengths)), dtype=np.uint64)
                for tree in range(trees):
                    prefix = np.full(len(rows), tree + 1, dtype=np.uint64)
                    for d in range(depth):
                        low = np.minimum.reduceat(values * SEEDS[tree * depth + d], at)
                        prefix = rolling.mixed(prefix * np.uint64(0x9E3779B97F4A7C15) + low)
                        if d + 1 in lengths:
                            out[:, tree * len(lengths) + lengths.index(d + 1)] = prefix
                lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * out.shape[1], pa.array(out.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(node[step.first + rows]), lists], names=["node", "prefixes"])

    return sign


def candidates(texts: DataFrame, trees: int, depth: int, threshold: float, recall: float, leaf: int) -> DataFrame:
    """(a, b): pairs of texts that meet in a leaf, or with a pivot in a larger node."""
    lengths = levels(trees, depth, threshold, recall)
    signed = texts.select("node", "text").mapInArrow(signature_batches(trees, lengths, depth), "node long, prefixes array<long>")
    # copies have one signature; they meet before the shuffle and after it
    signed = signed.groupBy("node").agg(F.any_value("prefixes").alias("prefixes"))
    each = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), *[F.get("prefixes", t * len(lengths) + i).alias(f"p{k}") for i, k in enumerate(lengths)]))
    forest = stored(signed.select("node", F.inline(each)), "forest")
    order = lambda c: F.xxhash64(F.lit(10), c)
    walk, star, open_ = forest, [], F.lit(True)
    leaf_prefix = F.lit(None).cast("long")
    for k in lengths:
        p = f"p{k}"
        large = forest.groupBy("tree", p).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order(F.col("node")), "node"))["node"].alias("pivot")).filter(F.col("n") > leaf)
        large = stored(large.select("tree", p, F.col("pivot").alias(f"v{k}")), f"forest-large-{k}")
        walk = walk.join(bounded_broadcast(large, MAX_BROADCAST_NODES), ["tree", p], "left")
        leaf_prefix = F.coalesce(leaf_prefix, F.when(F.col(f"v{k}").isNull(), F.col(p)))
        star.append(F.struct(F.col(f"v{k}").alias("a"), F.col("node").alias("b")))
    pivots = walk.select(F.explode(F.array_distinct(F.filter(F.array(*star), lambda s: s["a"].isNotNull() & (s["a"] != s["b"])))).alias("s")).select("s.a", "s.b").distinct()
    leaves = walk.withColumn("leaf", leaf_prefix).filter("leaf is not null").groupBy("tree", "leaf").agg(F.collect_set(F.struct(order(F.col("node")).alias("o"), "node")).alias("m"))
    # the same group often is a leaf of many tries
    groups = leaves.filter(F.size("m") > 1).select(F.transform(F.sort_array("m"), lambda s: s["node"]).alias("m")).distinct()
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    near = groups.select(F.explode(pairs).alias("s")).select("s.a", "s.b")
    return near.unionByName(pivots)


def gram_counter(parts: int):
    """Grams of texts by part, as blobs of their upper halves."""

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            values = np.concatenate([np.zeros(0, dtype=np.uint64), *[grams(step)[0] for step in rolling.steps(batch.column("text"))]])
            part = values % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            at, first = np.unique(part[order], return_index=True)
            blobs = [v.tobytes() for v in np.split((values[order] >> np.uint64(32)).astype(np.uint32), first[1:])] if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(blobs, pa.binary())], names=["part", "halves"])

    def count(table):
        import pyarrow as pa

        half, n = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("halves").to_pylist()]), return_counts=True)
        often = n > FEW
        key = half[often].astype(np.uint64) << np.uint64(32) | np.uint64(table.column("part")[0].as_py())
        return pa.table({"key": key.view(np.int64), "n": n[often].astype(np.int64)})

    return deal, count


def frequent(texts: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (upper half and part) of the grams of many texts, sorted, and how many; 2^32 keys a part, so few grams share one."""
    deal, count = gram_counter(parts)
    many = stored(texts.select("text").mapInArrow(deal, "part long, halves binary").groupBy("part").applyInArrow(count, "key long, n long"), "join-frequent")
    least = FEW
    while many.filter(F.col("n") > least).count() > MAX_FREQUENT:
        least *= 2
    found = many.filter(F.col("n") > least).toArrow()
    key, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(key)
    # one more that no gram has
    return np.append(key[order], np.uint64((1 << 64) - 1)), np.append(n[order], 0)


def prefix_batches(threshold: float, parts: int, known: np.ndarray, often: np.ndarray):
    """The first grams of texts, as blobs: those of few texts by the gram, from part 0 on, frequent ones by the text, below 0."""

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            node, found = batch.column("node").to_numpy(zero_copy_only=False), []
            for step in rolling.steps(batch.column("text")):
                values, first = grams(step)
                row = np.repeat(np.arange(step.n), np.diff(first))
                key = values >> np.uint64(32) << np.uint64(32) | values % np.uint64(parts)
                at = np.searchsorted(known, key)
                many = np.where(known[at] == key, often[at], 0)
                order = np.lexsort((values, many, row))
                values, many, row = values[order], many[order], row[order]
                new = np.concatenate([[True], (values[1:] != values[:-1]) | (row[1:] != row[:-1])])[: len(values)]
                values, many, row = values[new], many[new], row[new]
                n = np.bincount(row, minlength=step.n)
                place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                own = place <= (n - np.ceil(threshold * n - 1e-9))[row]
                values, many, row = values[own], many[own], row[own]
                of = node[step.first + row]
                part = np.where(many > 0, -1 - (of.view(np.uint64) % np.uint64(parts)).astype(np.int64), (values % np.uint64(parts)).astype(np.int64))
                found.append((part, values, of, n[row].astype(np.int32)))
            if not found:
                continue
            part, *columns = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(part, kind="stable")
            at, first = np.unique(part[order], return_index=True)
            blobs = [pa.array([v.tobytes() for v in np.split(c[order], first[1:])] if len(at) else [], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(at), *blobs], names=["part", "grams", "nodes", "sizes"])

    return deal


def meet(threshold: float):
    """Of a part of first grams: the pairs (a, b) of texts that share one, or the frequent ones (gram, a, size)."""

    def pair(table):
        import pyarrow as pa

        gram, node, n = (np.concatenate([np.frombuffer(b, t) for b in table.column(c).to_pylist()]) for c, t in (("grams", np.int64), ("nodes", np.int64), ("sizes", np.int32)))
        order = np.lexsort((node, gram))
        gram, node, n = gram[order], node[order], n[order]
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])])
        gram, node, n = gram[new], node[new], n[new]
        if table.column("part")[0].as_py() < 0:
            return pa.table({"gram": gram, "a": node, "b": pa.nulls(len(node), pa.int64()), "size": n})
        found, i = [np.zeros((0, 2), dtype=np.int64)], np.arange(len(gram))
        for step in range(1, len(gram)):
            i = i[i + step < len(gram)]
            i = i[gram[i] == gram[i + step]]
            if not len(i):
                break
            near = np.minimum(n[i], n[i + step]) >= threshold * np.maximum(n[i], n[i + step]) - 1e-6
            found.append(np.stack([node[i[near]], node[i[near] + step]], axis=1))
        both = np.unique(np.concatenate(found), axis=0)
        return pa.table({"gram": pa.nulls(len(both), pa.int64()), "a": both[:, 0], "b": both[:, 1], "size": pa.nulls(len(both), pa.int32())})

    return pair


def shared_prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """(gram, a, b, size), stored: pairs (a, b) of texts that share a first gram of few texts, and frequent first grams (gram, a, size)."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + chars // PART_CHARS
    deal = prefix_batches(threshold, parts, *frequent(texts, parts))
    dealt = texts.select("node", "text").mapInArrow(deal, "part long, grams binary, nodes binary, sizes binary")
    return stored(dealt.groupBy("part").applyInArrow(meet(threshold), "gram long, a long, b long, size int"), "join-prefixes")


def verify_batches(threshold: float):
    """The pairs whose grams have the similarity, with it."""

    def sets(column) -> list[np.ndarray]:
        out = []
        for step in rolling.steps(column):
            values, first = grams(step)
            out += [np.unique(values[a:z]) for a, z in zip(first[:-1], first[1:], strict=True)]
        return out

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            # a pivot is on many rows of a batch; its grams are made once
            left = batch.column("text_a").dictionary_encode()
            one, two, of = sets(left.dictionary), sets(batch.column("text_b")), left.indices.to_numpy()
            alike = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                x, y = one[of[i]], two[i]
                if len(x) and len(y) and min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    alike[i] = both / (len(x) + len(y) - both)
            good = pa.array(alike >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good), pa.array(alike).filter(good)], names=["a", "b", "similarity"])

    return verify


def verified(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of texts (node, text) that reach the threshold."""
    wanted = bounded_broadcast(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), MAX_BROADCAST_TEXTS)
    sides = texts.select("node", "text").join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
    both = pairs.join(sides.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").join(sides.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify_batches(threshold), "a long, b long, similarity double")


def gram_batches(batches):
    """(node, grams) of each text, each gram once."""
    import pyarrow as pa

    for batch in batches:
        node = batch.column("node").to_numpy(zero_copy_only=False)
        for step in rolling.steps(batch.column("text")):
            values, first = grams(step)
            sets = [np.unique(values[a:z]) for a, z in zip(first[:-1], first[1:], strict=True)]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)], dtype=np.int32), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node[step.first : step.first + step.n]), lists], names=["node", "grams"])


def block_links(threshold: float):
    """Of the texts (node, grams) of side 0 and side 1, or within side 0 if it is alone: how many links each has (a, n), and a few (a, b) that hold their classes together."""

    def compare(table):
        import pyarrow as pa

        side, n = table.column("side").to_numpy(), table.column("grams").combine_chunks().value_lengths().to_numpy().astype(np.int64)
        order = np.lexsort((n, side))
        table, side, n = table.take(order), side[order], n[order]
        node = table.column("node").to_numpy()
        # grams are numbered, so that one text's marks are looked up by all others at once
        number = np.unique(table.column("grams").combine_chunks().flatten().to_numpy(), return_inverse=True)[1]
        first, marked = np.concatenate([[0], np.cumsum(n)]), np.zeros(len(number), dtype=np.int8)
        middle, found = int(np.searchsorted(side, 1)), [np.zeros((2, 0), dtype=np.int64)]
        within = middle == len(side)
        for i in range(middle):
            # in order of size, the texts that may be alike stand together
            low, high = (0 if within else middle) + np.searchsorted(n[(0 if within else middle) :], [threshold * n[i] - 1e-6, n[i] / threshold + 1e-6], side="left")
            low = max(low, i + 1) if within else low
            if low >= high:
                continue
            own = number[first[i] : first[i + 1]]
            marked[own] = 1
            both = np.add.reduceat(marked[number[first[low] : first[high]]], first[low:high] - first[low], dtype=np.int64)
            marked[own] = 0
            at = low + np.flatnonzero(both / (n[i] + n[low:high] - both) >= threshold)
            found.append(np.stack([np.full(len(at), i), at]))
        x, y = np.concatenate(found, axis=1)
        links, label = np.bincount(np.concatenate([x, y]), minlength=len(n)), np.arange(len(n))
        while (label[x] != label[y]).any():
            least = np.minimum(label[x], label[y])
            np.minimum.at(label, x, least)
            np.minimum.at(label, y, least)
        some, held = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(n)))
        b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[held])])
        return pa.table({"a": np.concatenate([node[some], node[label[held]]]), "b": b, "n": np.concatenate([links[some], np.zeros(len(held), dtype=np.int64)])})

    return compare


def families(shared: DataFrame) -> DataFrame:
    """(node, family, n), stored: texts that share frequent first grams with others, and their numbers of grams."""
    crowd = shared.filter("gram is not null")
    pivots = crowd.groupBy("gram").agg(F.min("a").alias("pivot"), F.max("a").alias("last")).filter("pivot < last").select("gram", "pivot")
    edges = crowd.join(bounded_broadcast(pivots, MAX_FREQUENT), "gram").select(F.col("pivot").alias("a"), F.col("a").alias("b")).filter("a != b").distinct()
    nodes = crowd.groupBy(F.col("a").alias("node")).agg(F.any_value("size").alias("n"))
    labels = components(nodes.select("node", F.lit(0).alias("doc")), edges)
    return stored(labels.select("node", F.col("label.node").alias("family")).join(nodes, "node"), "join-families")


def family_links(texts: DataFrame, member: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): how many links a text has within its family (node, family, n), in pieces, and links that hold classes together.  Texts of a family are dealt into blocks; each two of them meet in a task."""
    member = member.withColumn("weight", F.greatest("n", F.lit(LEAST_GRAMS)))
    wide = member.groupBy("family").agg(F.ceil(F.sum("weight") / BLOCK_GRAMS).alias("parts")).filter("parts > 1")
    dealt = F.pmod(F.xxhash64(F.lit(11), "node"), F.coalesce("parts", F.lit(1)))
    placed = stored(member.join(bounded_broadcast(wide, MAX_BROADCAST_BLOCKS), "family", "left").select("node", "family", dealt.alias("block")), "join-placed")
    own = texts.select("node", "text").join(bounded_broadcast(placed.select("node"), MAX_BROADCAST_CROWD), "node", "left_semi")
    held = stored(own.groupBy("node").agg(F.any_value("text").alias("text")).mapInArrow(gram_batches, "node long, grams array<long>"), "join-grams")
    blocks = stored(placed.select("family", "block").distinct(), "join-blocks")
    pairs = blocks.join(blocks.select("family", F.col("block").alias("other")), "family").filter("block <= other")
    sides = F.when(F.col("block") == F.col("other"), F.array("block")).otherwise(F.array("block", "other"))
    sides = pairs.select("family", "block", "other", F.posexplode(sides).alias("side", "of")).select(F.struct("family", "block", "other").alias("pair"), "side", "family", F.col("of").alias("block"))
    rows = held.join(bounded_broadcast(placed, MAX_BROADCAST_CROWD), "node").join(bounded_broadcast(sides, MAX_BROADCAST_BLOCKS), ["family", "block"])
    return stored(rows.select("pair", "side", "node", "grams").groupBy("pair").applyInArrow(block_links(threshold), "a long, b long, n long"), "join-family-links")


def links(texts: DataFrame, threshold: float = 0.8, recall: float = 0.999, trees: int = 16, depth: int = 8, leaf: int = 16) -> tuple[DataFrame, DataFrame]:
    """(a, b) and (node, n_links) of texts (node, text), in which copies may repeat: links that hold the classes together, and how many each text has."""
    shared = shared_prefixes(texts, threshold)
    member = families(shared)
    once = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = once(candidates(texts, trees, depth, threshold, recall, leaf)).unionByName(once(shared.filter("gram is null"))).distinct()
    # pairs within a family are compared there
    side = lambda c: bounded_broadcast(member.select(F.col("node").alias(c), F.col("family").alias(f"f{c}")), MAX_BROADCAST_CROWD)
    apart = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter("fa is null or fb is null or fa != fb").select("a", "b")
    found = stored(verified(texts, stored(apart, "join-candidates"), threshold), "join-found").select("a", "b", F.lit(1).cast("long").alias("n"))
    held = family_links(texts, member, threshold)
    degree = found.select(F.explode(F.array("a", "b")).alias("node"), "n").unionByName(held.filter("b is null").select(F.col("a").alias("node"), "n"))
    return found.unionByName(held.filter("b is not null")).select("a", "b"), degree.groupBy("node").agg(F.sum("n").alias("n_links"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) of nodes (node, doc): the smallest (doc, node) of each linked node's component.

    Each round a node takes the smallest label among itself and its neighbours; only sums and minima
    by node are shuffled.  Stars around pivots settle in a few rounds.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "components-edges")
    linked = nodes.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    labels = stored(linked.select("node", F.struct("doc", "node").alias("label")), "components-labels")
    while True:
        offered = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("label").alias("offer"))
        after = labels.join(offered.withColumnRenamed("b", "node"), "node", "left")
        after = stored(after.select("node", F.least("label", F.coalesce("offer", "label")).alias("label"), (F.col("offer") < F.col("label")).alias("changed")), "components-labels")
        labels = after.select("node", "label")
        if after.filter("changed").isEmpty():
            return labels


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, trees: int = 16, depth: int = 8, leaf: int = 16) -> DataFrame:
    """(doc_id, key, node, class_id, class_node, n_links, is_first): a row for each row of docs (doc_id, text).

    key is the text's MD5; n_links the links of its text to different texts; is_first marks the
    rows of the class's smallest doc_id and first text.
    """
    small_batches(docs.sparkSession)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = docs.select("doc_id", F.md5("text").alias("key"), "text", own.alias("own")).withColumn("node", F.xxhash64("key"))
    light = stored(rows.select("doc_id", "key", "own", F.when(F.col("key").isNotNull(), F.col("node")).alias("node")), "join-rows")
    texts = light.filter("key is not null").groupBy("key", "node").agg(F.min("own").alias("doc"))
    found, degree = links(rows.filter("key is not null"), threshold, recall, trees, depth, leaf)
    labels = components(texts.select("node", "doc"), found)
    classes = texts.select("key", "node", "doc").join(labels, "node", "left").join(degree, "node", "left")
    classes = classes.select("key", "node", F.coalesce("label", F.struct("doc", "node")).alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = light.drop("node").join(classes, "key", "left")
    class_doc = F.when(F.col("label.doc") == LAST, F.lit(None).cast("long")).otherwise(F.col("label.doc"))
    return out.select(
        "doc_id",
        "key",
        "node",
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(class_doc).alias("class_id"),
        F.col("label.node").alias("class_node"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("label").isNull() | ((F.col("label.doc") == F.col("own")) & (F.col("label.node") == F.col("node")))).alias("is_first"),
    )


def first_of_each_class(docs: DataFrame, **how) -> DataFrame:
    """docs (doc_id, text and any columns) with one row of each class, that of its smallest doc_id."""
    own, key = fresh(docs, "own", "key")
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), lambda c: F.coalesce(c, F.lit(""))
    keep = join(docs.select("doc_id", "text"), **how).filter("is_first").select(doc.alias(own), text(F.col("key")).alias(key)).distinct()
    rows = docs.withColumns({own: doc, key: text(F.md5("text"))})
    # rows that agree in doc_id and text are one document
    return rows.join(keep, [own, key], "left_semi").dropDuplicates([own, key]).select(*docs.columns)


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "is_first")

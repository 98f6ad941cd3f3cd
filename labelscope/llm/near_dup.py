"""MinHash near-dedup by a signature-coordinate inverted join.

1. A Python pass over whole texts gives each document its number of distinct
   5-word shingles, a fingerprint of that set and a signature of ``K`` minima.
   Documents with equal sets form a class; one representative goes on.
2. Representatives are posted under every (coordinate, value) pair. Pairs that only
   one holds are left out: they cannot collide. The others are ordered by how many
   hold them; two representatives that agree on ``M`` of ``K`` coordinates must share
   one of the rarest ``kept - M + 1``, so the ``M - 1`` longest lists of each are set
   aside and only the rest, its prefix, is posted on.
3. Posting lists are merged in blocks bounded by members and by shingles. A merge
   counts collisions over the posted coordinates, skips members whose sizes forbid
   the similarity, and probes the lists set aside for those that can still reach
   ``M``. A pair is looked at in one list only, the longest of those that both are
   posted on. Members with a partner are put out, never pairs.
4. The blocks that are left get the members' texts. Common shingles are counted
   exactly through an inverted list of the block's shingles, for one pivot after the
   other against those that nothing connects with it yet; edges that connect what the
   links connect are put out, one for each member at most.
5. A list of several blocks is first merged block by block, each with the same few
   anchors in it, so that a family of near copies becomes one component in work that
   grows as its size. What is left are members of different components: the blocks of
   those outside the list's largest component then meet every other block, once.

A pair of similarity 0.75 misses ``M`` = 12 of ``K`` = 32 with probability 1.7e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import textkernel as tk
from labelscope.llm.common import bound_batches, cut, join_side, released, table
from labelscope.llm.components import connected_components

K, M, WIDTH = 32, 12, 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Members and shingles of a block of a posting list (a single larger text is a block of its own);
#: members of a list, on average, that are in every of its blocks.
BLOCK, BLOCK_SHINGLES, ANCHORS = 1024, 400_000, 32

_rng = np.random.Generator(np.random.PCG64(77))
_MUL = _rng.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(1, 2**63, K, dtype=np.uint64)


def text_shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, shingle hashes, offsets) for slices of a text column."""
    raw, offs = tk.buffers(column)
    for lo, hi, part, at in tk.slices(raw, offs):
        part = tk.LOWER[part]
        starts, ends, woffs = tk.word_spans(part, at, tk.NONSPACE)
        yield lo, hi, *tk.shingles(tk.word_hashes(part, starts, ends), woffs, WIDTH)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        count, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        sig = np.zeros((n, K), np.uint32)
        for lo, hi, sh, so in text_shingles(batch.column("text")):
            some = np.flatnonzero(np.diff(so) > 0)
            if not len(some):
                continue
            for k in range(K):
                sig[lo + some, k] = np.minimum.reduceat(((sh ^ _XOR[k]) * _MUL[k]) >> np.uint64(32), so[some])
            for d in some:
                s = np.sort(sh[so[d] : so[d + 1]])
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
                count[lo + d], one[lo + d] = len(s), s.sum(dtype=np.uint64)
                two[lo + d] = np.bitwise_xor.reduce(tk.mix(s * np.uint64(0xD6E8FEB86659FD93)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(count), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                pa.FixedSizeListArray.from_arrays(pa.array(sig.view(np.int32).ravel()), K).cast(pa.list_(pa.int32())),
            ],
            names=["doc_id", "n_shingles", "f1", "f2", "sig"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (fingerprint of the set), sig (K minima; zeros for an empty set)."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        released(_sign), "doc_id long, n_shingles long, f1 long, f2 long, sig array<int>"
    )


def _grouped(batches: Iterator[pa.RecordBatch], arrays) -> Iterator[dict[str, np.ndarray]]:
    """Columns (by ``arrays``) of every run of equal (token, i, j) in sorted batches."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {k: np.concatenate([h[k] for h in held]) for k in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        now = arrays(batch)
        new = np.zeros(batch.num_rows, bool)
        for key in ("token", "i", "j"):
            new[1:] |= now[key][1:] != now[key][:-1]
        bounds = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        if held and any(held[-1][key][-1] != now[key][0] for key in ("token", "i", "j")):
            yield whole()
            held = []
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            if x:
                yield whole()
                held = []
            held.append({k: v[x:y] for k, v in now.items()})
    if held:
        yield whole()


_KEYS = ("token", "i", "j", "rep", "block", "component")


def _plain(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {name: batch.column(name).to_numpy(zero_copy_only=False) for name in _KEYS}


def _wide(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    rank = np.full((batch.num_rows, K), -1, np.int8)
    ranked = batch.column("ranked")
    row = np.repeat(np.arange(batch.num_rows), np.diff(ranked.offsets.to_numpy()))
    place = np.arange(len(row)) - np.repeat(ranked.offsets.to_numpy()[:-1] - ranked.offsets[0].as_py(), np.diff(ranked.offsets.to_numpy()))
    rank[row, ranked.flatten().to_numpy()] = place
    return _plain(batch) | {
        "n": batch.column("n").to_numpy(zero_copy_only=False), "sig": batch.column("sig").flatten().to_numpy().reshape(-1, K), "rank": rank,
    }


def _colliding(g: dict[str, np.ndarray]) -> np.ndarray:
    """Members of a block that have a partner in it: another component, fitting sizes, ``M`` collisions, and this
    list as the pair's own.

    ``rank`` orders a member's posted coordinates by the lengths of their lists; a pair's own list is the last of
    those that both are posted on.
    """
    here = int(g["token"][0]) >> 32
    sig, rank, size, component = g["sig"], g["rank"], g["n"], g["component"]
    posted = rank >= 0
    split = g["i"][0] != g["j"][0]
    used = np.zeros(len(sig), bool)
    for at in range(len(sig) - 1):
        n = size[at + 1 :]
        ok = (100 * np.minimum(n, size[at]) >= PERCENT * np.maximum(n, size[at])) & (component[at + 1 :] != component[at])
        if split:
            ok &= g["block"][at + 1 :] != g["block"][at]
        rest = np.flatnonzero(ok) + at + 1
        if not len(rest):
            continue
        mine = np.flatnonzero(posted[at])
        same = sig[rest][:, mine] == sig[at, mine]
        count = same.sum(1)
        owned = ~(same & posted[rest][:, mine] & (rank[at, mine] > rank[at, here])).any(1)
        aside = np.flatnonzero(~posted[at])
        maybe = np.flatnonzero(owned & (count + len(aside) >= M))
        count = count[maybe] + (sig[rest[maybe]][:, aside] == sig[at, aside]).sum(1)
        good = rest[maybe[count >= M]]
        if len(good):
            used[at] = used[good] = True
    return used


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for g in _grouped(batches, _wide):
        used = _colliding(g)
        if used.any():
            yield pa.RecordBatch.from_arrays([pa.array(g[k][used]) for k in _KEYS], names=list(_KEYS))


def _with_sets(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    sets = np.empty(batch.num_rows, object)
    for lo, hi, sh, so in text_shingles(batch.column("text")):
        for d in range(hi - lo):
            sets[lo + d] = np.unique(sh[so[d] : so[d + 1]])
    return _plain(batch) | {"sets": sets}


def connecting_pairs(sets: list[np.ndarray], component: np.ndarray, block: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what links between arrays of distinct elements, and equal components, connect.

    A pivot's common elements with all others are counted through an inverted list of
    the elements. Pivots are taken while anything outside the largest component has
    not been one, so in a family of near copies there are few. With ``block``, only
    pairs of different blocks are looked at.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(size) - size
    order = np.argsort(flat, kind="stable")
    holder = np.repeat(np.arange(n, dtype=np.int32), size)[order]
    first = np.searchsorted(flat[order], np.arange(int(flat.max(initial=-1)) + 2))
    group = np.unique(component, return_inverse=True)[1]
    weight = np.bincount(group)
    waiting = np.ones(n, bool)
    left, right = [], []
    while True:
        left_out = np.flatnonzero(waiting & (group != weight.argmax()))
        if not len(left_out):
            break
        at = int(left_out[0])
        waiting[at] = False
        mine = flat[starts[at] : starts[at] + size[at]]
        common = np.bincount(holder[tk.ranges(first[mine], first[mine + 1] - first[mine])], minlength=n)
        good = (common > 0) & (100 * common >= PERCENT * (size + size[at] - common)) & (group != group[at])
        if block is not None:
            good &= block != block[at]
        found = np.flatnonzero(good)
        found = found[np.unique(group[found], return_index=True)[1]]  # one for each component that it joins
        left.append(np.full(len(found), at))
        right.append(found)
        if len(found):
            joined = np.zeros(len(weight), bool)
            joined[group[found]] = joined[group[at]] = True
            group = np.where(joined[group], group[at], group)
            weight = np.bincount(group, minlength=len(weight))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for g in _grouped(batches, _with_sets):
        a, b = connecting_pairs(list(g["sets"]), g["component"], g["block"] if g["i"][0] != g["j"][0] else None)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(g["rep"][a]), pa.array(g["rep"][b])], names=["a", "b"])


def prefixes(reps: DataFrame) -> DataFrame:
    """(rep, n, sig, ranked): ``ranked`` are the coordinates that a representative is posted on, shortest list first."""
    posted = reps.select("rep", F.posexplode("sig").alias("k", "v")).select("rep", _token("k", "v"))
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df >= 2")
    kept = posted.join(shared, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("kept"))
    prefix = F.expr(f"transform(slice(kept, 1, size(kept) - {M} + 1), x -> int(shiftright(x.token, 32)))")
    return reps.join(kept.filter(F.size("kept") >= M).select("rep", prefix.alias("ranked")), "rep")


def _token(k: str, v: str):
    return (F.shiftleft(F.col(k).cast("long"), 32) + F.col(v).cast("long").bitwiseAND(0xFFFFFFFF)).alias("token")


def posting_lists(members: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """(token, rep, length, blocks) for every posting of a list of at least two members."""
    posted = members.select("rep", "n", "sig", F.explode("ranked").alias("k"))
    posted = posted.select("rep", "n", "k", F.expr("sig[k]").alias("v")).select("rep", "n", _token("k", "v"))
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).cast("int")
    lists = posted.groupBy("token").agg(F.count("*").alias("length"), blocks.alias("blocks")).filter("length >= 2")
    return posted.select("token", "rep").join(lists, "token")


def _merged(dealt: DataFrame, members: DataFrame) -> DataFrame:
    """The members of ``dealt`` (token, i, j, rep, block, component) that have partners in their blocks."""
    kinds = "token long, i int, j int, rep long, block int, component long"
    return _sorted_blocks(dealt.join(members, "rep")).mapInArrow(released(_merge), kinds)


def block_by_block(postings: DataFrame) -> DataFrame:
    """Every posting in its block, and its list's anchors in every block; all components differ."""
    home = F.pmod(F.xxhash64("rep", "token"), F.col("blocks")).cast("int")
    anchor = F.pmod(F.xxhash64("token", "rep"), F.greatest(F.ceil(F.col("length") / ANCHORS), F.lit(1))) == 0
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    at = F.explode(F.when((F.col("blocks") > 1) & anchor, every).otherwise(F.array(home)))
    return postings.select("token", "rep", at.alias("i")).select(
        "token", "i", F.col("i").alias("j"), "rep", F.col("i").alias("block"), F.col("rep").alias("component")
    )


def outside_against_all(postings: DataFrame, component: DataFrame) -> DataFrame:
    """For lists of several blocks and components: blocks of those outside the largest component, each against all.

    Blocks from 0 on hold the others, blocks below 0 the largest component, whose members do not meet each other.
    """
    placed = postings.filter("blocks > 1").join(component, postings["rep"] == component["node"], "left").select(
        "token", "rep", "length", "blocks", F.coalesce("component", "rep").alias("component")
    )
    counts = placed.groupBy("token", "length", "blocks", "component").agg(F.count("*").alias("rows"))
    largest = counts.groupBy("token", "length", "blocks").agg(F.max(F.struct("rows", "component")).alias("largest"))
    apart = F.col("length") - F.col("largest.rows")
    share = F.ceil(F.col("blocks") * apart / F.col("length")).cast("int")
    plan = largest.filter(apart > 0).select("token", F.col("largest.component").alias("main"), share.alias("outer"), (F.col("blocks") - share + 1).alias("inner"))
    dealt = placed.select("token", "rep", "component").join(plan, "token")
    hashed = F.xxhash64("rep", "token")
    inside = F.col("component") == F.col("main")
    dealt = dealt.withColumn("block", F.when(inside, -1 - F.pmod(hashed, F.col("inner"))).otherwise(F.pmod(hashed, F.col("outer"))).cast("int"))
    first = F.when(inside, F.lit(0)).otherwise(-F.col("inner"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(first.cast("int"), (F.col("outer") - 1).cast("int"))))
    return dealt.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "block", "component")


def _sorted_blocks(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j", "rep")


def confirmed(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) that join the members of ``found`` as their links, confirmed on full sets, do."""
    needed = join_side(cut(found.select(F.col("rep").alias("doc_id")).distinct()))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(needed, "doc_id", "left_semi").withColumn("digest", F.xxhash64("text")).dropDuplicates(["doc_id", "digest"])
    return _sorted_blocks(found.join(cut(texts).drop("digest"), F.col("rep") == F.col("doc_id")).drop("doc_id")).mapInArrow(released(_confirm), "a long, b long")


def links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the members as their links do."""
    postings = cut(posting_lists(members, BLOCK, BLOCK_SHINGLES))
    edges = cut(confirmed(cut(_merged(block_by_block(postings), members)), docs))
    if postings.filter("blocks > 1").isEmpty():
        return edges
    rest = cut(outside_against_all(postings, connected_components(edges)))
    return edges if rest.isEmpty() else edges.unionByName(confirmed(cut(_merged(rest, members)), docs))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of ``docs`` (doc_id, text).

    class_id is the smallest doc_id with the same shingle set, component_id the
    smallest doc_id reachable by links; a document without words is alone. A null
    text is empty. Rows repeated with the same doc_id come out as often as they came
    in, each judged by its own text; where two different texts of one doc_id are both
    the first of their class, the classes are joined. Rows with a null doc_id come out
    with null ids and link with nothing. Other columns of ``docs`` are not read. An
    empty table gives no rows.
    """
    signed = cut(signatures(docs))
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.first("sig").alias("sig")
    )
    classes = cut(classes)
    members = cut(prefixes(classes.select("rep", F.col("n_shingles").alias("n"), "sig")))
    component = connected_components(links(members, docs))
    reps = classes.select("f1", "f2", "n_shingles", "rep")
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(reps, ["f1", "f2", "n_shingles"], "left")
    out = out.join(component, F.col("rep") == F.col("node"), "left")
    alone = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", "n_shingles",
        F.when(alone, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(alone, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(sz.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN sz ON sz.doc_id = w.doc_id LEFT JOIN low ON low.x = w.doc_id
"""

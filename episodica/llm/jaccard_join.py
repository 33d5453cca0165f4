"""Exact n-gram Jaccard self-join by a token-group matrix.

Words are lower-cased runs without ASCII blanks; a document's set holds its distinct SHINGLE-word shingles as 64-bit
hashes (with fewer words, the whole sequence). Sets link where 100 * intersection >= 75 * union. The steps:

1. Shingles meet by ranges of their hashes, and each document learns which of its own another one has too. A set of n
   shingles can only link if three quarters of n are shared by anyone: the others, most of a usual corpus, are alone.
   What is left is written once, as sorted hashes; texts aren't read again.
   Documents with equal sets are one from here on (the one with the least id); they link by definition.
2. Grouping: sets that share a min-hash key are held against the key's first set, exactly. Linked sets are a group;
   a large group is cut into blocks of about BLOCK sets. Sets without a link are grouped by their first min-hash key and
   size: alike, though not linked, as far as is known. Of such loose blocks all pairs of sets are still open.
3. The matrix: among the sets that are left each shingle's number of sets is counted, exactly. Of each set the first
   n - ceil(0.75 n) + DEPTH shingles, rare ones first, are entries (token, set), and the first n - ceil(6/7 n) + DEPTH are
   marked as enough against sets that aren't smaller. Shingles that one set has stand first and need no entry. Entries
   become (token, block): each block's union of those tokens.
4. Bound: linked sets share DEPTH of these tokens, or all that they must share if that is less. So only blocks of
   different groups that share as many, and whose sizes allow a link, stay candidates. Tokens of many blocks are dealt
   out in tiles of TILE by TILE blocks.
5. Open: of each candidate pair of blocks the one with more sets is opened, once for all its pairs. A set of another
   block whose overlap with the opened block's whole union is less than three quarters of its size is dismissed; the
   others are held against the members, exactly. First the likeliest partner of each block of linked sets, then what is
   left between groups that are still apart, and the loose blocks, each against itself too.

No step lists pairs within a group: a group of any size is tied together by links to its first set, and loose sets are
compared inside of opened blocks. Passages that many
documents share come last in the order, so they are no entries unless a set consists of little else.

Null, empty or blank texts have empty sets and link with nothing. Rows with one id count as one document; rows without
an id have a size but no component (null). Repeated rows give repeated rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .meeting import NAMES, batch_of, by_bucket, cuts, found_in, gathered, name_of, pack_sorted, ranges, repeated, send_names, unpack_sorted
from .runtime import Scratch, id_map, partitions, picked, prepare
from .spans import DARK_BYTES, LOWER, U64, blocks, gram_hashes, hash_runs, mix, pack, runs, unpack

SHINGLE, KEYS, DEPTH, BLOCK, TILE = 5, 4, 4, 128, 256
_SALTS = [U64(0xA0761D6478BD642F * (2 * k + 1) & (1 << 64) - 1) for k in range(KEYS)]


def shingle_sets(texts: pa.Array, size: int = SHINGLE):
    """For each row its sorted distinct shingles."""
    for _, _, data, offsets in blocks(texts):
        data = LOWER[data]
        starts, ends, first = runs(data, offsets, DARK_BYTES)
        words = hash_runs(data, starts, ends)
        grams = gram_hashes(words, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            else:
                yield gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, U64)


def linked(common: int, n: int, m: int) -> bool:
    return 4 * common >= 3 * (n + m - common)


def _signed(x) -> int:
    return int(np.uint64(x).astype(np.int64))


def named(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(home, text) -> shingles, to meet."""
    gather = gathered(n_buckets)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for home, tokens in zip(batch.column("home").to_pylist(), shingle_sets(batch.column("text")), strict=True):
                if len(tokens):
                    parts.append((np.unique(name_of(tokens)), home))
                    size += len(tokens)
                if size >= gather:
                    yield send_names(parts, n_buckets)
                    parts, size = [], 0
        if parts:
            yield send_names(parts, n_buckets)

    return docs.mapInArrow(run, NAMES)


_SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64())), ("tokens", pa.binary())])


def sets(rows: DataFrame) -> DataFrame:
    """Shared shingles (kind 0) and texts (kind 1) by home -> (id, n, s1, s2, keys, tokens) for each text.

    s1 and s2 tell sets apart. keys (least hashes) and tokens (the shared shingles) are null if the set can't link.
    """

    def run(batches):
        now, parts, table = None, [], None
        for batch in batches:
            out, kinds = [], batch.column("kind").to_pylist()
            columns = [batch.column(c).to_pylist() for c in ("home", "id", "names")]
            for kind, home, doc_id, names, tokens in zip(kinds, *columns, shingle_sets(batch.column("text")), strict=True):
                if home != now:
                    now, parts, table = home, [], None
                if kind == 0:
                    parts.append(unpack_sorted(names))
                    continue
                if table is None:
                    table, parts = np.unique(np.concatenate(parts)) if parts else np.zeros(0, U64), []
                n = len(tokens)
                if not n:
                    out.append((doc_id, 0, 0, 0, None, None))
                    continue
                spread = mix(tokens ^ _SALTS[0])
                s1, s2 = _signed(spread.sum(dtype=U64)), _signed(np.bitwise_xor.reduce(mix(spread + _SALTS[1])))
                shared = tokens[found_in(name_of(tokens), table, True)]
                keys = tokens_of = None
                if 4 * len(shared) >= 3 * n:
                    keys = [_signed(mix(shared + s).min()) for s in _SALTS]
                    tokens_of = pack_sorted(shared)
                out.append((doc_id, n, s1, s2, keys, tokens_of))
            if out:
                yield batch_of(out, _SETS)

    return rows.mapInArrow(run, "id long, n long, s1 long, s2 long, keys array<long>, tokens binary")


def _gatherings(batches, gather: int):
    """(home, number, ids, sizes, tokens, answers), one gathering of a home's sets after another.

    Answers (kind 0) come before sets (kind 1), and sets by id and digest, so gatherings are the same whenever made.
    """
    now, number, ids, sizes, parts, size, answers = None, 0, [], [], [], 0, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["home"] != now:
                if ids:
                    yield now, number, ids, sizes, parts, answers
                now, number, ids, sizes, parts, size, answers = row["home"], 0, [], [], [], 0, {}
            if row["kind"] == 0:
                answers.setdefault(row["number"], []).append((row["bucket"], row["data"]))
                continue
            ids.append(row["id"])
            sizes.append(row["n"])
            parts.append(unpack_sorted(row["data"]))
            size += len(parts[-1])
            if size >= gather:
                yield now, number, ids, sizes, parts, answers
                number, ids, sizes, parts, size = number + 1, [], [], [], 0
    if ids:
        yield now, number, ids, sizes, parts, answers


def ask(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Sets by home -> (bucket, home, number, keys, counts): each gathering's tokens and in how many of its sets they are."""
    gather = gathered(n_buckets)
    schema = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("number", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for home, number, _, _, parts, _ in _gatherings(batches, gather):
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            if len(keys):
                yield batch_of([(b, home, number, pack_sorted(keys[x:y]), pack(counts[x:y])) for b, x, y in cuts(ranges(keys, n_buckets))], schema)

    return rows.mapInArrow(run, "bucket int, home int, number int, keys binary, counts binary")


def answer(asked: DataFrame) -> DataFrame:
    """For each row of keys one byte a key: the logarithm of its number of sets, rounded up (0: one set)."""

    def work(rows):
        parts = [unpack_sorted(r.pop("keys")) for r in rows]
        keys = np.concatenate(parts)
        counts = np.concatenate([unpack(r.pop("counts"), np.int64) for r in rows])
        order = np.argsort(keys)
        first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        total = np.add.reduceat(counts[order], first)
        level = np.empty(len(keys), np.uint8)
        level[order] = np.repeat(np.minimum(np.ceil(np.log2(total)), 31).astype(np.uint8), np.diff(np.append(first, len(keys))))
        out, at = [], 0
        for row, p in zip(rows, parts, strict=True):
            out.append((row["bucket"], row["home"], row["number"], pack(level[at : at + len(p)])))
            at += len(p)
        yield batch_of(out, pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("number", pa.int32()), ("levels", pa.binary())]))

    return by_bucket(asked, "bucket int, home int, number int, levels binary", work)


def prefix(tokens: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
    """The first tokens of a set of n in the common order, as 64-bit keys: five bits of level, the rest of hash.

    Tokens of one set (level 0, or not among tokens at all) stand first and are left out. The last bit marks the tokens
    that are enough where the other set isn't smaller: linked sets then share 6/7 of this one. Where it is smaller, three
    quarters of this one are shared. Empty if the set can't link.
    """
    tokens, level = tokens[level > 0], level[level > 0]
    if 4 * len(tokens) < 3 * n:
        return tokens[:0]
    most, few = (min(n, n - math.ceil(share * n) + DEPTH) - (n - len(tokens)) for share in (3 / 4, 6 / 7))
    keys = (level.astype(U64) << U64(59) | (mix(tokens) >> U64(5))) & ~U64(1)
    keys = np.sort(keys)[:most]
    keys[: max(few, 0)] |= U64(1)
    return keys


def entries(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Levels and sets by home -> blobs (bucket, tokens, ids): the matrix entries of each set, dealt by token."""
    gather = gathered(n_buckets)

    def run(batches):
        for _, number, ids, sizes, parts, answers in _gatherings(batches, gather):
            keys = np.unique(np.concatenate(parts))
            levels = dict(answers.pop(number, ()))
            level = np.concatenate([unpack(levels[b], np.uint8) for b, _, _ in cuts(ranges(keys, n_buckets))]) if len(keys) else np.zeros(0, np.uint8)
            found = [prefix(p, level[np.searchsorted(keys, p)], n) for p, n in zip(parts, sizes, strict=True)]
            tokens = np.concatenate(found)
            of = np.repeat(np.array(ids, np.int64), [len(f) for f in found])
            bucket = ranges(mix(tokens & ~U64(1)), n_buckets)
            order = np.argsort(bucket, kind="stable")
            tokens, of, bucket = tokens[order], of[order], bucket[order]
            out = [(b, tokens[x:y].tobytes(), pack(of[x:y])) for b, x, y in cuts(bucket)]
            if out:
                yield batch_of(out, pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("ids", pa.binary())]))

    return rows.mapInArrow(run, "bucket int, tokens binary, ids binary")


def shared_entries(blobs: DataFrame) -> DataFrame:
    """(token, rep, few) of every token that several documents have."""

    def work(rows):
        keys = np.concatenate([np.frombuffer(r["tokens"], U64) for r in rows])
        ids = np.concatenate([unpack(r["ids"], np.int64) for r in rows])
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        few, keys = (keys & U64(1)).astype(bool), keys & ~U64(1)
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[1:] == keys[:-1]
        keep = same[1:] | same[:-1]
        keys, ids, few = keys[keep].view(np.int64), ids[keep], few[keep]
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(ids[at : at + (1 << 16)]), pa.array(few[at : at + (1 << 16)])], ["token", "rep", "few"])

    return by_bucket(blobs, "token long, rep long, few boolean", work)


def may_link(x: str, y: str) -> Column:
    """Whether a set of block x may link with one of block y, by the tokens that the unions of their prefixes share.

    Two sets of n <= m tokens share DEPTH tokens of their prefixes (or all that they must). Of the two prefixes one ends
    first in the common order: up to there all that the sets share is counted, and beyond it the smaller set has at
    most 6/7 n + 1 - DEPTH tokens and the greater one 3/4 m + 1 - DEPTH. Linked sets share 3/7 (n + m) tokens.
    """
    shared, low, high = F.col("shared"), (lambda s: F.col(f"{s}l")), (lambda s: F.col(f"{s}h"))
    need = F.least(F.lit(DEPTH), F.ceil(F.greatest(low(x), low(y)) * 3 / 4))
    have = shared + 1 - DEPTH + 1e-6

    def reach(q: str, g: str) -> Column:
        """With q the smaller set: its prefix ends first, or that of the greater set g does."""
        first = have >= (F.greatest(low(g), low(q)) - F.least(high(q), high(g))) * 3 / 7
        second = have + F.greatest(high(g) * 0.75, F.lit(DEPTH - 1.0)) >= (high(g) + F.greatest(low(q), high(g) * 0.75)) * 3 / 7
        return first | second

    tiny = F.least(high(x), high(y)) <= 7 * DEPTH  # a prefix may be the whole set
    return (shared >= need) & (tiny | reach(x, y) | reach(y, x))


def block_pairs(cells_of: DataFrame) -> DataFrame:
    """Cells by token and tile -> (x, y, shared and what is known of both): pairs of blocks of different groups that share tokens.

    A cell is (token, tile, chunk, tiles of two chunks, few, block and its l: least and h: greatest set size, r: root,
    c: number of sets, f: 1 if loose, low and high: sizes of the sets that have the token). x is of the group with the
    greater root; a loose block is a group of its own here.
    A token counts if it is one of the few of either.
    """
    parts = partitions(cells_of.sparkSession)
    known = ("block", "l", "h", "r", "c", "f")
    names = [f"{s}{k}" for s in "xy" for k in ("", *known[1:])] + ["shared"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches):
        count: dict = {}

        def send():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((*x, *y, k) for (x, y), k in count.items()), strict=True)], schema=schema)
            count.clear()
            return out

        def add(rows):
            root, low, high, few, chunk = (np.array([r[j] for r in rows], np.int64) for j in (3, 6, 7, 8, 9))
            one, two = rows[0][10], rows[0][11]
            infos = [tuple(r[:6]) for r in rows]
            for i in range(len(root)):
                fits = (root < root[i]) & (3 * low <= 4 * high[i]) & (3 * low[i] <= 4 * high) & (few | few[i] > 0)
                if one != two:  # pairs within a chunk are counted by the chunk's own tile
                    fits &= chunk != chunk[i]
                for j in np.flatnonzero(fits).tolist():
                    pair = infos[i], infos[j]
                    count[pair] = count.get(pair, 0) + 1
                if len(count) > 50_000:
                    yield send()

        now, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("token", "tile", *known, "low", "high", "few", "chunk", "one", "two")]
            for token, tile, *row in zip(*columns, strict=True):
                if (token, tile) != now:
                    if rows:
                        yield from add(rows)
                    now, rows = (token, tile), []
                rows.append(row)
        if rows:
            yield from add(rows)
        if count:
            yield send()

    dealt = cells_of.repartition(parts, "token", "tile").sortWithinPartitions("token", "tile")
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def tiled(cells_of: DataFrame) -> DataFrame:
    """Cells whose token leads out of a group, once for each tile of two chunks of about TILE of the token's blocks."""
    of = cells_of.groupBy("token").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.ceil(F.count("*") / TILE).cast("int").alias("chunks")).where("r0 <> r1")
    cells_of = cells_of.join(of.select("token", "chunks"), "token").withColumn("chunk", F.pmod(F.xxhash64("block"), F.col("chunks")).cast("int"))
    both = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, "chunk").alias("one"), F.greatest(k, "chunk").alias("two")))
    return cells_of.select("*", F.explode(both).alias("t")).select("*", "t.one", "t.two", (F.col("t.one").cast("long") * F.col("chunks") + F.col("t.two")).alias("tile")).drop("t", "chunks")


#: Kinds of rows of a unit: members of a loose block, members that are linked, queries, queries that are members too.
LOOSE, LINKED, QUERY, OWN = -1, 0, 1, 2


def opened(rows: DataFrame) -> DataFrame:
    """Sets that link, among rows (unit, kind, id, n, tokens): members of each unit against its queries.

    A unit's members are held as a group with the union of their tokens; queries stream past. A query whose overlap
    with the union is too small is dismissed; otherwise it is held against the members: against all of a loose block, of
    linked ones until one links, which is all that its component needs.
    """

    def run(batches):
        now, members, union, loose = None, [], None, False
        for batch in batches:
            found_a, found_b = [], []
            for unit, kind, doc_id, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("unit", "kind", "id", "n", "tokens")), strict=True):
                if unit != now:
                    now, members, union, loose = unit, [], None, False
                tokens = unpack_sorted(tokens)
                if kind <= LINKED:
                    members.append((doc_id, n, tokens))
                    loose = kind == LOOSE
                    continue
                if not members:
                    continue
                if union is None:
                    union = np.unique(np.concatenate([m for _, _, m in members]))
                if len(members) > 1 and 4 * int(found_in(tokens, union, True).sum()) < 3 * n:
                    continue
                for other, m, theirs in members:
                    if kind == OWN and other >= doc_id:
                        break  # members come by id: the pair is the other one's to find
                    if 3 * m <= 4 * n and 3 * n <= 4 * m and linked(int(found_in(tokens, theirs, True).sum()), n, m):
                        found_a.append(doc_id)
                        found_b.append(other)
                        if not loose:
                            break
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def open_units(live: DataFrame, units: DataFrame) -> DataFrame:
    """units (unit, kind, id, s1) -> links (a, b). A unit with many queries is dealt over several tasks, each with all members."""
    parts = partitions(live.sparkSession)
    fan = units.where(F.col("kind") >= QUERY).groupBy("unit").agg(F.ceil(F.count("*") / 256).cast("int").alias("fan"))
    units = units.join(fan, "unit")
    members = units.where(F.col("kind") <= LINKED).select("unit", "kind", "id", "s1", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"))
    queries = units.where(F.col("kind") >= QUERY).select("unit", "kind", "id", "s1", F.pmod(F.xxhash64("id"), F.col("fan")).cast("int").alias("part"))
    wanted = members.union(queries).select(F.xxhash64("unit", "part").alias("unit"), "kind", "id", "s1")
    rows = live.join(wanted, ["id", "s1"]).select("unit", "kind", "id", "n", "tokens")
    return opened(rows.repartition(parts, "unit").sortWithinPartitions("unit", "kind", "id"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows with what groups says of their keys (inner). size: how many rows a group has, of total ones.

    Groups of more than a quarter of an even share of all rows are at most 4 for each partition: they are broadcast, and
    their rows stay where they are.
    """
    hot = F.col(size) * 4 * partitions(rows.sparkSession) >= total
    large, rest = F.broadcast(groups.where(hot).drop(size)), groups.where(~hot).drop(size)
    return rows.join(large, keys).unionByName(rows.join(large, keys, "left_anti").join(rest, keys))


def stars_of(live: DataFrame) -> DataFrame:
    """(x, xs, y, ys): for each min-hash key of several sets its first set, and each other set whose size allows a link."""
    keyed = live.select(F.col("id").alias("rep"), "s1", "n", F.posexplode("keys").alias("k", "key"))
    heads = keyed.groupBy("k", "key").agg(F.min_by(F.struct("rep", "s1", "n"), F.struct("rep", "s1")).alias("head"), F.count("*").alias("size")).where("size > 1")
    pairs = join_groups(keyed, heads, ["k", "key"], "size", KEYS * live.count())
    pairs = pairs.where("(rep, s1) <> (head.rep, head.s1) and 3 * n <= 4 * head.n and 3 * head.n <= 4 * n")
    return pairs.select(F.col("head.rep").alias("x"), F.col("head.s1").alias("xs"), F.col("rep").alias("y"), F.col("s1").alias("ys")).distinct()


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col (long), n_shingles, component_id (the least id that links lead to, its own included)."""
    spark = prepare(docs.sparkSession)
    scratch, parts = Scratch(spark, "jaccard"), partitions(spark)
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    source = source.select(F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int").alias("home"), "id", "text")
    none = lambda kind: F.lit(None).cast(kind)
    shared = repeated(named(source, parts)).select("home", F.lit(0).alias("kind"), none("long").alias("id"), none("string").alias("text"), "names")
    rows = shared.union(source.select("home", F.lit(1), "id", "text", none("binary")))
    every = scratch.table(sets(rows.repartitionById(parts, F.col("home")).sortWithinPartitions("home", "kind")))
    stats = every.select("id", "n", "s1", "s2")
    reps = stats.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))

    # One row for each set that may link; an id may have several sets.
    able = every.where("tokens is not null and id is not null")
    firsts = able.groupBy("n", "s1", "s2").agg(F.min("id").alias("id"))
    live = able.join(firsts, ["n", "s1", "s2", "id"], "left_semi").dropDuplicates(["n", "s1", "s2", "id"])
    live = scratch.table(live.select(F.pmod(F.xxhash64("id", "s1"), F.lit(parts)).cast("int").alias("home"), "id", "n", "s1", "keys", "tokens"))

    # Grouping: each min-hash key's first set, and the others against it.
    stars = scratch.table(stars_of(live), thin=True)
    units = stars.select(F.xxhash64("x", "xs").alias("unit"), F.lit(0).alias("kind"), F.col("x").alias("id"), F.col("xs").alias("s1")).distinct()
    units = scratch.table(units.union(stars.select(F.xxhash64("x", "xs"), F.lit(1), "y", "ys")), thin=True)
    links = scratch.table(open_units(live, units), thin=True)
    roots = scratch.table(components(links, scratch), thin=True)

    # The matrix.
    mine = live.select("home", F.lit(1).alias("kind"), "id", "n", "s1", none("int").alias("number"), none("int").alias("bucket"), F.col("tokens").alias("data"))
    deal = lambda df: df.repartitionById(parts, F.col("home")).sortWithinPartitions("home", "kind", "id", "s1")
    told = answer(ask(deal(mine), parts)).select("home", F.lit(0), none("long"), none("long"), none("long"), "number", "bucket", "levels")
    token_rows = shared_entries(entries(deal(mine.union(told)), parts))
    info = live.groupBy(F.col("id").alias("rep")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min(F.col("keys")[0]).alias("key"))
    info = info.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("f", F.col("root").isNull().cast("int"))
    step = F.floor(F.log(F.col("high")) / math.log(4 / 3))
    info = info.select("rep", "low", "high", "f", F.when(F.col("f") == 1, F.xxhash64("key", step)).otherwise(F.col("root")).alias("r"))
    split = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.when((split == 1) & (F.col("f") == 0), F.col("r")).otherwise(F.xxhash64("r", "f", F.pmod(F.xxhash64("rep"), split)))
    info = info.join(info.groupBy("r", "f").agg(F.count("*").alias("members")), ["r", "f"]).withColumn("block", block)
    info = scratch.table(info.select("rep", "low", "high", "f", F.when(F.col("f") == 1, F.col("block")).otherwise(F.col("r")).alias("r"), "block"), thin=True)
    whole = info.groupBy("block").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.count("*").alias("c"))
    cells_of = token_rows.join(info.join(whole, "block"), "rep").groupBy("token", "block").agg(*(F.first(c).alias(c) for c in "lhrcf"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("few").alias("few"))
    found = block_pairs(tiled(scratch.table(cells_of)))
    sides = [f"{s}{k}" for s in "xy" for k in ("", *"lhrcf")]
    pairs = found.groupBy(*sides).agg(F.sum("shared").alias("shared")).where(may_link("x", "y"))
    pairs = scratch.table(pairs.select("x", "y", "xr", "yr", "xc", "yc", (F.col("xf") + F.col("yf") == 0).alias("tied"), "shared"), thin=True)

    # Open: first the likeliest partner of each block of linked sets, then all that is left.
    found, sets_of = links, live.select(F.col("id").alias("rep"), "s1").join(info.select("rep", "block", "f"), "rep")
    alone = info.where("f = 1").groupBy("block").count().where("count > 1").select(F.col("block").alias("query"), F.col("block").alias("unit"))
    for last in (False, True):
        if last:
            now = roots.select(F.col("node").alias("r"), "root")
            todo = pairs.join(now.select(F.col("r").alias("xr"), F.col("root").alias("xq")), "xr", "left").join(now.select(F.col("r").alias("yr"), F.col("root").alias("yq")), "yr", "left")
            todo = todo.where(~F.col("tied") | (F.coalesce("xq", "xr") != F.coalesce("yq", "yr")))
        else:
            todo = pairs.where("tied").groupBy("x").agg(F.max_by(F.struct("y", "xc", "yc"), F.struct("shared", "y")).alias("best")).select("x", "best.*")
        # The block with more sets is the unit: its members are read once, however many blocks are held against it.
        query, unit = (F.when(F.col("xc") > F.col("yc"), F.col(p)).otherwise(F.col(q)) for p, q in ("yx", "xy"))
        todo = todo.select(query.alias("query"), unit.alias("unit"))
        todo = scratch.table(todo.union(alone) if last else todo, thin=True)
        if todo.isEmpty():
            continue
        kind = F.when(F.col("query") == F.col("unit"), OWN).otherwise(QUERY)
        queries = todo.join(sets_of.withColumnRenamed("block", "query"), "query").select("unit", kind.alias("kind"), F.col("rep").alias("id"), "s1")
        kind = F.when(F.col("f") == 1, LOOSE).otherwise(LINKED)
        members = todo.select("unit").distinct().join(sets_of.withColumnRenamed("block", "unit"), "unit").select("unit", kind.alias("kind"), F.col("rep").alias("id"), "s1")
        more = scratch.table(open_units(live, scratch.table(members.union(queries), thin=True)), thin=True)
        if not more.isEmpty():
            found = found.union(more)
            roots = scratch.table(components(found, scratch), thin=True)
    scratch.keep(every, roots)
    final = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("root", "rep").alias("root"), "copies")
    linkable = (F.col("n") > 0) & F.col("id").isNotNull()
    out = join_groups(stats.where(linkable), final, ["n", "s1", "s2"], "copies", stats.count()).select("id", "n", "root")
    out = out.union(stats.where(~linkable).select("id", "n", F.col("id").alias("root")))  # without id: null
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").cast("long").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose component has a document with a lesser id; of rows that share an id one stays.

    Rows without an id stay. Only documents of groups are shuffled, the others just pass.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    found = scratch.table(jaccard_components(docs, id_col=id_col, text_col=text_col), thin=True)
    stay = found.where(F.col("component_id") == F.col(id_col)).groupBy(id_col).count()
    unsure = id_map(found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("id")).union(stay.where("count > 1").select(id_col)))
    chosen = picked(docs, unsure, True, id_col).join(stay.select(id_col), id_col, "left_semi").dropDuplicates([id_col])
    return picked(docs, unsure, False, id_col).union(chosen.select(docs.columns)).union(docs.where(docs[id_col].isNull()))


#: For DuckDB: every pair of documents that shares a shingle, then the transitive closure of links.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""

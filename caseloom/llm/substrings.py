"""Removal of repeated passages, exact, by fixed-block anchors.

A window of 50 words always holds one whole aligned block of 25 words of the document
it is found in. So: index each document's non-overlapping blocks of 25, probe them with
every rolling window of 25 of every document, and only the passages around hits can
repeat. Hits are extended to whole windows of 50, compared by 96-bit keys against the
smallest document that holds them, and consecutive windows make up the maximal repeats.

How it stays bounded: documents are worked through in batches of a few megabytes and
probes leave a batch once per hash, however many documents of the batch share it, so a
passage found in a third of all documents costs one entry per batch. Buckets and chunks
grow in number, not in size, with the corpus. Probes carry 32 bits next to their bucket;
a chance match only costs a comparison later. The text itself is shuffled once.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.ship import ship
from ..functions.staging import staged
from .base import WORD, partitions, query, table
from .texts import arrow_map, by_bytes, cogrouped, forget, grouped

WINDOW = 50
BATCH = 6 << 20         # bytes of text hashed together
CHUNK = 6 << 20         # bytes of text of the documents that come together, about
BUCKET = 16 << 20       # bytes of text whose probes come together, about
MEMO = 300_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_WORDS = re.compile(WORD)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Hasher:
    """Hashes of words and of runs of words; words seen lately are kept."""

    def __init__(self):
        self.memo: dict = {}
        self.up = np.ones(1, _U)
        self.down = np.ones(1, _U)

    def words(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, words), _U, len(words))
        except KeyError:
            for w in set(words):
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w.encode())
            return np.fromiter(map(memo.__getitem__, words), _U, len(words))

    def _powers(self, n):
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, _U), np.full(size - 1, _BASE, _U)]).cumprod(dtype=_U)
                self.down = np.concatenate([np.ones(1, _U), np.full(size - 1, _BACK, _U)]).cumprod(dtype=_U)

    def runs(self, h: np.ndarray, size: int) -> np.ndarray:
        """Hash of each run of ``size`` words: a polynomial from two prefix sums."""
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, _U)
        self._powers(len(h))
        total = np.zeros(len(h) + 1, _U)
        np.cumsum(h * self.up[:len(h)], out=total[1:])
        return mix((total[size:] - total[:n]) * self.down[:n])

    def keys(self, h: np.ndarray, size: int) -> np.ndarray:
        """96-bit keys of the runs: 64 bits and 32 independent bits."""
        out = np.zeros(max(0, len(h) - size + 1), KEY)
        out["a"] = self.runs(h, size)
        out["b"] = (self.runs(mix(h + _U(_BASE)), size) >> _U(32)).astype(np.uint32)
        return out


KEY = np.dtype([("a", "<u8"), ("b", "<u4")])


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as bytes: like bytes side by side, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(
        b"".join(np.ascontiguousarray(p).tobytes() for p in planes))


def unsqueeze(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * 64))
    out, at = [], 0
    for k in map(np.dtype, kinds):
        plane = np.frombuffer(raw, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(k))
        at += n * k.itemsize
    return out


def _edges(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    n = len(sorted_values)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [n]])


def _parts(owner: np.ndarray, *arrays):
    """(owner, arrays of its rows) for each owner."""
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    e = _edges(owner)
    for s, t in zip(e[:-1], e[1:]):
        yield int(owner[s]), [a[order[s:t]] for a in arrays]


def _prime(n: int) -> int:
    n = max(2, n)
    while any(n % k == 0 for k in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def _wrap(rows: pa.Table) -> bytes:
    """Rows as compressed bytes."""
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, rows.schema, options=options) as w:
        w.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unwrap(packets: list, schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table()] + [
        pa.ipc.open_stream(p).read_all() for p in packets]).combine_chunks()


def _bundle(batches):
    """Rows of a batch that go to one chunk, as one packet."""
    forget()
    for b in by_bytes(batches, "__text", BATCH):
        t = pa.Table.from_batches([b])
        rows = [(0, c, len(at), _wrap(t.take(pa.array(at)))) for c, (at,) in
                _parts(b.column("chunk").to_numpy(), np.arange(b.num_rows))]
        yield _packets(rows)


_PACKET = "bucket int, chunk int, n bigint, data binary"
_NAMES = ["bucket", "chunk", "n", "data"]


def _packets(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
        names=_NAMES)


def _probe(buckets: int, chunks: int, block: int):
    """Per batch: probes for each bucket; hits among the batch's own documents."""
    def run(batches):
        forget()
        hasher = Hasher()
        for b in by_bytes(batches, "__text", BATCH):
            ids, found, owner, aligned = [], [], [], []
            for i, t in zip(b.column("__id").to_pylist(), b.column("__text").to_pylist()):
                if i is None or not t:
                    continue
                h = hasher.runs(hasher.words(_WORDS.findall(t)), block)
                if len(h):
                    found.append(h)
                    owner.append(np.full(len(h), len(ids), np.uint32))
                    aligned.append(np.arange(len(h)) % block == 0)
                    ids.append(i)
            if not ids:
                continue
            ids = np.array(ids, np.int64)
            h, doc, index = np.concatenate(found), np.concatenate(owner), np.concatenate(aligned)
            order = np.argsort(h, kind="stable")
            h, number, index = h[order], doc[order], index[order]
            doc = ids[number]
            table_of_ids = squeeze(ids)
            table_of_ids = (struct.pack("<II", len(ids), len(table_of_ids)) + table_of_ids)
            e = _edges(h)
            first, size = e[:-1], np.diff(e)
            many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            any_index = np.logical_or.reduceat(index, first)
            rows = []
            # shared within the batch: the documents need no answer from elsewhere
            own = np.repeat(many, size)
            for c, (d, k) in _parts(doc[own] % chunks, doc[own], h[own].astype(np.uint32)):
                rows.append((int(c) % buckets, c, len(d), squeeze(d, k)))
            flags = many.astype(np.uint8) + 2 * any_index.astype(np.uint8)
            hk = h[first]
            for k, (low, d, f) in _parts((hk >> _U(32)) % _U(buckets), hk.astype(np.uint32),
                                         number[first], flags):
                up = np.argsort(low, kind="stable")
                rows.append((k, -1, len(low), table_of_ids + squeeze(
                    np.diff(low[up], prepend=np.uint32(0)), d[up], f[up])))
            yield _packets(rows)
    return run


def _meet(chunks: int):
    """In a bucket: hashes that a block has and two documents share, sent to their chunks."""
    def run(t: pa.Table) -> pa.Table:
        low, doc, flag, rows = [], [], [], []
        for b, c, n, data in zip(*(t.column(x).to_pylist() for x in _NAMES)):
            if c >= 0:
                rows.append((b, c, n, data))
                continue
            m, size = struct.unpack_from("<II", data)
            ids, = unsqueeze(data[8:8 + size], m, np.int64)
            k, d, f = unsqueeze(data[8 + size:], n, np.uint32, np.uint32, np.uint8)
            low.append(np.cumsum(k, dtype=np.uint32))
            doc.append(ids[d])
            flag.append(f)
        if low:
            low, doc, flag = map(np.concatenate, (low, doc, flag))
            order = np.argsort(low, kind="stable")
            low, doc, flag = low[order], doc[order], flag[order]
            e = _edges(low)
            first, size = e[:-1], np.diff(e)
            shared = ((np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))
                      | (np.maximum.reduceat(flag & 1, first) > 0))
            shared &= np.maximum.reduceat(flag & 2, first) > 0
            ask = np.repeat(shared, size) & (flag & 1 == 0)
            for c, (d, k) in _parts(doc[ask] % chunks, doc[ask], low[ask]):
                rows.append((0, c, len(d), squeeze(d, k)))
        return pa.Table.from_batches([_packets(rows)])
    return run


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for the places in a run of ``size`` from any start."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + size, n), -1)
    return np.cumsum(step[:-1]) > 0


def _finish(words: list[str], starts: np.ndarray, window: int):
    """(words removed, text of the words kept)."""
    if not len(starts):
        return 0, " ".join(words)
    gone = _covered(starts, len(words), window)
    return int(gone.sum()), " ".join(w for w, g in zip(words, gone.tolist()) if not g)


def _result(kept: str, digest: bool) -> str:
    return hashlib.sha256(kept.encode()).hexdigest() if digest else kept


def _extend(buckets: int, window: int, block: int, digest: bool, names: list[str],
            inside: pa.Schema, schema: pa.Schema):
    """In a chunk: finish documents without hits; for the others, keys of the windows
    around hits, once per key, and which windows repeat inside the chunk."""
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        hasher = Hasher()
        docs = _unwrap(docs.column("data").to_pylist(), inside)
        d, k = [], []
        for n, data in zip(hits.column("n").to_pylist(), hits.column("data").to_pylist()):
            x, y = unsqueeze(data, n, np.int64, np.uint32)
            d.append(x)
            k.append(y)
        by_doc = {}
        if d:
            by_doc = {i: np.unique(x) for i, (x,) in _parts(np.concatenate(d), np.concatenate(k))}
        total = docs.num_rows
        n_words, kept = np.zeros(total, np.int64), [None] * total
        keys, row, place, owner = [], [], [], []
        ids, texts = docs.column("__id").to_pylist(), docs.column("__text").to_pylist()
        for r, (i, t) in enumerate(zip(ids, texts)):
            words = _WORDS.findall(t) if t else []
            n_words[r] = len(words)
            wanted = by_doc.get(i)
            at = np.zeros(0, np.int64)
            if wanted is not None and len(words) >= window:
                h = hasher.words(words)
                hit = np.flatnonzero(np.isin(hasher.runs(h, block).astype(np.uint32), wanted))
                # a window from q holds the block runs from q to q + window - block
                around = _covered(np.maximum(hit - (window - block), 0), len(words),
                                  window - block + 1) if len(hit) else at
                at = np.flatnonzero(around[:len(words) - window + 1])
            if not len(at):
                kept[r] = _result(" ".join(words), True) if digest else t or ""
                continue
            keys.append(hasher.keys(h, window)[at])
            row.append(np.full(len(at), r, np.int64))
            place.append(at)
            owner.append(np.full(len(at), i, np.int64))
        packets, local = [], {}
        if keys:
            keys, row, place, owner = map(np.concatenate, (keys, row, place, owner))
            order = np.lexsort((owner, keys["b"], keys["a"]))
            keys, row, place, owner = keys[order], row[order], place[order], owner[order]
            e = _edges(keys)
            first = e[:-1]
            least = owner[first]
            late = owner > np.repeat(least, np.diff(e))
            local = {r: p for r, (p,) in _parts(row[late], place[late])}
            one = keys[first]
            for b, (x, y, z) in _parts((one["a"] >> _U(20)) % _U(buckets), one["a"], one["b"], least):
                packets.append((b, len(x), squeeze(x, y, z)))
        done = [r for r in range(total) if kept[r] is not None]
        rest = [r for r in range(total) if kept[r] is None]
        if rest:
            marks = [local.get(r, np.zeros(0, np.int64)).astype(np.uint32).tobytes() for r in rest]
            held = docs.take(pa.array(rest)).append_column("n_words", pa.array(n_words[rest])) \
                .append_column("local", pa.array(marks, pa.binary()))
            packets.append((-1, len(rest), _wrap(held)))
        chunk = (docs if total else hits).column("chunk")[0].as_py()
        none, extra = [None] * len(done), len(packets)
        at = docs.take(pa.array(done, pa.int64()))
        cols = {x: pa.concat_arrays([at.column(x).combine_chunks(), pa.nulls(extra, schema.field(x).type)])
                for x in names}
        cols |= {"kind": [0] * len(done) + [1 if p[0] < 0 else 2 for p in packets],
                 "chunk": [chunk] * (len(done) + extra),
                 "bucket": none + [p[0] for p in packets], "n": none + [p[1] for p in packets],
                 "data": none + [p[2] for p in packets],
                 "n_words": n_words[done].tolist() + [None] * extra,
                 "n_removed": [0] * len(done) + [None] * extra,
                 "kept": [kept[r] for r in done] + [None] * extra}
        return pa.Table.from_arrays([pa.array(cols[f.name], f.type) if isinstance(cols[f.name], list)
                                     else cols[f.name] for f in schema], schema=schema)
    return run


def _smallest(t: pa.Table) -> pa.Table:
    """In a bucket: keys whose smallest document is in another chunk, told to the rest."""
    a, b, doc, chunk, rows = [], [], [], [], []
    for c, n, data in zip(*(t.column(x).to_pylist() for x in ("chunk", "n", "data"))):
        x, y, z = unsqueeze(data, n, np.uint64, np.uint32, np.int64)
        a.append(x)
        b.append(y)
        doc.append(z)
        chunk.append(np.full(n, c, np.int64))
    if a:
        key = np.zeros(sum(map(len, a)), KEY)
        key["a"], key["b"] = np.concatenate(a), np.concatenate(b)
        doc, chunk = np.concatenate(doc), np.concatenate(chunk)
        order = np.lexsort((doc, key["b"], key["a"]))
        key, doc, chunk = key[order], doc[order], chunk[order]
        e = _edges(key)
        late = doc > np.repeat(doc[e[:-1]], np.diff(e))
        for c, (k,) in _parts(chunk[late], key[late]):
            rows.append((0, c, len(k), squeeze(k["a"], k["b"])))
    return pa.Table.from_batches([_packets(rows)])


def _cut(window: int, digest: bool, names: list[str], inside: pa.Schema, schema: pa.Schema):
    """In a chunk: remove the windows that repeat and give the words that stay."""
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        hasher = Hasher()
        docs = _unwrap(docs.column("data").to_pylist(), inside)
        keys = []
        for n, data in zip(told.column("n").to_pylist(), told.column("data").to_pylist()):
            x, y = unsqueeze(data, n, np.uint64, np.uint32)
            k = np.zeros(n, KEY)
            k["a"], k["b"] = x, y
            keys.append(k)
        keys = np.concatenate(keys) if keys else np.zeros(0, KEY)
        keys = keys[np.argsort(keys["a"], kind="stable")]
        removed, kept = [], []
        for t, local in zip(docs.column("__text").to_pylist(), docs.column("local").to_pylist()):
            words = _WORDS.findall(t)
            own = hasher.keys(hasher.words(words), window)
            at = np.searchsorted(keys["a"], own["a"])
            same = np.zeros(len(own), bool)
            step = 0
            while len(keys):       # keys with the same first part are few
                p = np.minimum(at + step, len(keys) - 1)
                alike = (keys["a"][p] == own["a"]) & (at + step < len(keys))
                if not alike.any():
                    break
                same |= alike & (keys["b"][p] == own["b"])
                step += 1
            starts = np.union1d(np.flatnonzero(same), np.frombuffer(local, np.uint32).astype(np.int64))
            n, text = _finish(words, starts.astype(np.int64), window)
            removed.append(n)
            kept.append(_result(text, digest) if digest or n else t)
        return pa.Table.from_arrays(
            [docs.column(x) for x in names] + [docs.column("n_words"), pa.array(removed, pa.int64()),
                                               pa.array(kept, pa.string())], schema=schema)
    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                   window: int = WINDOW, digest: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, plus n_words, n_removed and kept.

    A word goes if a window of ``window`` words that covers it also starts in a document
    with a smaller id. Words are maximal runs of anything but space, tab, line feed,
    vertical tab, form feed and carriage return, compared as they are. ``kept`` is the text
    as it was if nothing goes from it, else the words that stay, joined by one space. With
    ``digest`` it is the SHA-256, in hex, of the words that stay, joined by one space.

    Null and empty texts have no words. Rows with a null id take no part: nothing is
    removed from them or because of them. Rows that share an id do not count as repeats
    of each other. A column called n_words, n_removed or kept is replaced.
    """
    spark, block = docs.sparkSession, window // 2
    ship(spark)
    names = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept")]
    inner = [f"__c{i}" for i in range(len(names))]
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    floor = min(partitions(spark), size // (256 << 10) + 1)
    chunks, buckets = _prime(max(size // CHUNK, floor)), int(max(size // BUCKET, floor, 1))
    number = F.col(doc_id).cast("long")
    rows = docs.select(
        *[F.col(c).alias(i) for c, i in zip(names, inner)], number.alias("__id"),
        F.col(text).alias("__text"),
        F.coalesce(F.pmod(number, F.lit(chunks)), F.lit(0)).cast("int").alias("chunk"))
    probes = arrow_map(rows.select("__id", "__text"), _probe(buckets, chunks, block), _PACKET)
    hits = probes.groupBy("bucket").applyInArrow(grouped(_meet(chunks)), _PACKET)
    own = [T.StructField(i, docs.schema[c].dataType) for c, i in zip(names, inner)]
    mid = T.StructType(own + T.StructType.fromDDL(
        "kind int, chunk int, bucket int, n bigint, data binary, n_words bigint, "
        "n_removed bigint, kept string").fields)
    out = T.StructType(own + T.StructType.fromDDL(
        "n_words bigint, n_removed bigint, kept string").fields)
    inside = to_arrow_schema(rows.schema)
    held = inside.append(pa.field("n_words", pa.int64())).append(pa.field("local", pa.binary()))
    first = staged(arrow_map(rows, _bundle, _PACKET).groupBy("chunk")
                   .cogroup(hits.groupBy("chunk")).applyInArrow(
        cogrouped(_extend(buckets, window, block, digest, inner, inside, to_arrow_schema(mid))), mid))
    told = (first.filter("kind = 2").select("bucket", "chunk", "n", "data")
            .groupBy("bucket").applyInArrow(grouped(_smallest), _PACKET))
    rest = (first.filter("kind = 1").select("chunk", "data").groupBy("chunk")
            .cogroup(told.groupBy("chunk"))
            .applyInArrow(cogrouped(_cut(window, digest, inner, held, to_arrow_schema(out))), out))
    done = first.filter("kind = 0").select(*inner, "n_words", "n_removed", "kept")
    return done.unionByName(rest).select(
        *[F.col(i).alias(c) for c, i in zip(names, inner)], "n_words", "n_removed", "kept")


@query("op9_substring_dedup", r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as k from
    (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w)),
rep as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by k) as least from win)
    where least < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from rep),
kept as (select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from
    (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from w)
    anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
    sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)""")
def op9_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Words removed from all documents and what is kept, as a digest."""
    return remove_repeats(table(spark, d, "documents").select("doc_id", "text"), digest=True) \
        .withColumnRenamed("kept", "kept_sha256")

"""Removal of repeated byte strings by sparse suffix sorting.

A byte goes if some string of ``length`` bytes that covers it starts at another place too, in any document. A full suffix
array of the corpus is not needed for that: every window of bytes names one anchor, the smallest of its ``gram``-byte hashes
(leftmost on ties), which depends on its content alone. Equal windows so have anchors with equal grams, at the same distance;
the anchors of one gram are a bucket. A bucket's suffixes and its reversed prefixes, up to ``length`` bytes of each, are
sorted (deep-shallow: multikey quicksort, then blind tries). Neighbours' common prefixes give how far two places agree to
the left and to the right; if that is ``length`` bytes together, the whole stretch repeats.

- Texts that occur more than once repeat whole; one of them stands for all, so what follows sees distinct texts only.
- Anchors of a bucket with equal bytes all around are one string in the order, with a count.
- A bucket of more than ``most`` different strings is first split by ranges of windows and by the bytes that all windows of
  a range share, then by narrower ranges, at last by single windows; ranges with equal bytes count as one string. So no task
  holds more than ``most`` strings of a bucket, and a string is split into ranges a second time only where a passage in more
  than ``most`` contexts ends. The ranges are shuffled as digests; only what is left to sort gets its bytes.

``passage`` asks for a second, shorter length: bytes in strings of that length which repeat are counted from the same order,
beside the removal.

Defined results: null text counts as empty; texts below ``length`` bytes stay whole; repeated rows remove each other;
windows overlap and are judged on the input; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.deep_shallow import Prefixes, lcp
from docloom.llm.grouping import sorted_groups
from docloom.llm.storage import Scratch, materialise
from docloom.llm.wordhash import chunks, mix, string_buffers
from docloom.llm.worker import lean

LENGTH, GRAM, MOST = 400, 64, 512
#: bytes of a repeated passage that the query reports; 50 words in European languages are about 250 to 350
PASSAGE = 250
#: numbers of windows that a large bucket's strings are split by, one after the other
WIDTHS = (32, 6, 1)
#: strings of a bucket that are compared as whole matrices
MATRIX = 128
#: window starts of a long text that are looked at together, and bytes of text in a bucket of the table of texts
BLOCK, TABLE_BYTES = 1 << 20, 64 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
PLACE_BITS = np.uint64(40)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverses modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(n - 1, 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, in time that doesn't depend on w."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.append(x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, w)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[w - 1 : w - 1 + n])


def anchors_of(raw: np.ndarray, off: np.ndarray, least: int, gram: int, length: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, ...]:
    """Text index, anchor (from the start of the text), gram hash, hash of the bytes around it, and bytes to its right.

    ``off`` bounds the texts in ``raw``. Only windows that start from ``first`` to before ``last`` are looked at.
    """
    n, count = len(raw) - gram + 1, np.maximum(np.diff(off) - least + 1, 0)
    if n < 1 or not count.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    up, down = _powers(len(raw) + 1)
    total = np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1]))
    g = mix((total[gram:] - total[:n]) * down[:n])
    keyed = (g >> PLACE_BITS << PLACE_BITS) | np.arange(n, dtype=np.uint64)
    at = (window_minima(keyed, least - gram + 1) & np.uint64((1 << 40) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    start = np.repeat(off[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    if first or last is not None:
        on = (start >= first) & (start < (len(raw) if last is None else last))
        owner, start = owner[on], start[on]
    at = at[start]  # anchors never go back within a text
    new = np.append(True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))[: len(at)]
    a, own = at[new], owner[new]
    lo, hi = np.maximum(off[own], a - length), np.minimum(off[own + 1], a + length)
    around = mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64)) ^ mix((a - lo + 1).astype(np.uint64))
    return own, a - off[own], g[a].view(np.int64), around.view(np.int64), hi - a


def text_anchors(raw: np.ndarray, off: np.ndarray, least: int, gram: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchors_of`` for some texts, or for a long one block by block."""
    if len(off) > 2 or len(raw) <= 2 * BLOCK:
        yield anchors_of(raw, off, least, gram, length)
        return
    before = -1
    for s in range(0, len(raw) - least + 1, BLOCK):
        lo, hi = max(0, s - length), min(len(raw), s + BLOCK + least + length)
        own, a, g, d, right = anchors_of(raw[lo:hi], np.array([0, hi - lo]), least, gram, length, s - lo, s + BLOCK - lo)
        on = a + lo > before
        if on.any():
            before = int(a[-1]) + lo
        yield own[on], a[on] + lo, g[on], d[on], right[on]


def extents(pieces: list[bytes], anchors: list[int], lengths: list[int], depth: int = 0) -> np.ndarray:
    """How far each piece's repeated stretch goes to the left and right of its anchor: lengths x pieces x 2, 0 for none.

    All stretches of one piece meet at its anchor, so the longest to each side say it all.
    """
    n = len(pieces)
    out = np.zeros((len(lengths), n, 2), np.int64)
    left, right = [p[:a][::-1] for p, a in zip(pieces, anchors, strict=True)], [p[a:] for p, a in zip(pieces, anchors, strict=True)]
    if n == 2:
        x, y = lcp(left[0], left[1]), lcp(right[0], right[1])
        for k, length in enumerate(lengths):
            if x + y >= length:
                out[k] = x, y
        return out
    before, after = Prefixes(left), Prefixes(right, depth)
    if n <= MATRIX:
        x, y = (np.array([p.row(i) for i in range(n)]) for p in (before, after))
        np.fill_diagonal(x, -1)
        np.fill_diagonal(y, -1)
        for k, length in enumerate(lengths):
            ok = x + y >= length
            out[k, :, 0], out[k, :, 1] = np.where(ok, x, 0).max(axis=1), np.where(ok, y, 0).max(axis=1)
        return out
    for i in range(n):
        x, y = before.row(i), after.row(i)
        x[i] = y[i] = -1
        both = x + y
        for k, length in enumerate(lengths):
            ok = both >= length
            if ok.any():
                out[k, i] = x[ok].max(), y[ok].max()
    return out


MARK = "th binary, kind int, from int, to int"
MARK_TYPES = [pa.binary(), pa.int32(), pa.int32(), pa.int32()]


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in MARK_TYPES]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, MARK_TYPES, strict=True)], names=["th", "kind", "from", "to"])


def repeated_marks(texts: DataFrame, write: Scratch, lengths: list[int], gram: int, most: int) -> DataFrame:
    """``texts`` has distinct texts and th, a digest of each. Returns th, kind (place in ``lengths``), from, to: byte ranges that
    repeat; they may overlap."""
    least, length = min(lengths), max(lengths)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = string_buffers(b.column("text"))
            th = b.column("th")
            for i, j in chunks(off):
                for own, a, g, d, right in text_anchors(raw[off[i] : off[j]], off[i : j + 1] - off[i], least, gram, length):
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(d), th.take(pa.array(own + i)), pa.array(a.astype(np.int32)), pa.array(right.astype(np.int32))], names=["grp", "around", "th", "a", "right"])

    found = write(texts.select("th", "text").mapInArrow(lean(cut), "grp long, around long, th binary, a int, right int"), "suffix-anchors")
    met = write(found.groupBy("grp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("grp"), "suffix-met")
    shared = write(found.join(met, "grp", "left_semi"), "suffix-shared")
    write.forget(found, met)
    classes = write(shared.groupBy("grp", "around").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("th", "a")).alias("p")).select("grp", "around", "n", "p.th", "p.a"), "suffix-strings")

    # equal strings: each of them repeats as far as it goes
    same = shared.join(classes.where("n > 1").select("grp", "around"), ["grp", "around"], "left_semi")
    kinds = F.filter(F.array(*[F.when(F.least(F.col("a"), F.lit(length)) + F.col("right") >= x, F.lit(k)) for k, x in enumerate(lengths)]), lambda k: k.isNotNull())
    reach = same.select("th", F.explode(kinds).alias("kind"), (F.col("a") - F.least(F.col("a"), F.lit(length))).alias("from"), (F.col("a") + F.col("right")).alias("to"))
    marks = [write(reach, "suffix-marks")]
    write.forget(shared)

    # different strings of a bucket are sorted; their bytes come from their texts
    sizes = write(classes.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "suffix-buckets")
    wanted = classes.join(sizes, "grp").groupBy("th").agg(F.collect_list(F.struct("grp", "a", "n", "m")).alias("places"))  # as many as the text has anchors
    names, types = ["grp", "th", "a", "n", "m", "left", "piece"], [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    schema = "grp long, th binary, a int, n long, m long, left int, piece binary"

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, th = b.column("text")[i].as_py().encode("utf-8", "surrogatepass"), b.column("th")[i].as_py()
                places = b.column("places")[i].as_py()
                for k in range(0, len(places), 4096):
                    rows = [(p["grp"], th, p["a"], p["n"], p["m"], min(p["a"], length), text[max(0, p["a"] - length) : p["a"] + length]) for p in places[k : k + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    wanted = write(wanted, "suffix-wanted")
    pieces = write(texts.select("th", "text").join(wanted, "th").select("th", "text", "places").mapInArrow(lean(attach), schema), "suffix-bytes")
    write.forget(classes, sizes, wanted)

    def sort(of: list[int]):
        """Sorts buckets and marks what repeats of ``lengths`` at the places ``of``; strings with a count are marked already."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, at in sorted_groups(batches, "grp"):
                th, a, n, left, piece = (table.column(c).to_pylist() for c in ("th", "a", "n", "left", "piece"))
                out = []
                for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    reached = extents(piece[s:e], left[s:e], [lengths[k] for k in of], gram)
                    for k, i, _ in zip(*np.nonzero(reached[:, :, 1:]), strict=True):
                        x, y = reached[k, i].tolist()
                        if n[s + i] == 1:
                            out.append((th[s + i], of[k], a[s + i] - x, a[s + i] + y))
                yield _marks(out)

        return lean(run)

    def sorted_marks(p: DataFrame, of: list[int]) -> DataFrame:
        few = p.where(F.col("m") <= most).select("grp", "th", "a", "n", "left", "piece")
        return few.repartition("grp").sortWithinPartitions("grp").mapInArrow(sort(of), MARK)

    marks.append(sorted_marks(pieces, list(range(len(lengths)))))
    large = pieces.where(F.col("m") > most)
    if large.isEmpty():
        return _union(marks)

    def split(kind: int, width: int):
        """One row for each range of windows: what all of them share is the bucket, all that they cover the string."""
        size = lengths[kind]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for grp, th, a, n, left, piece in zip(*(b.column(c).to_pylist() for c in ("grp", "th", "a", "n", "left", "piece")), strict=True):
                    near, far = max(0, left + size - len(piece)), min(left, size - gram)  # distances of window starts from the anchor
                    for k in range(near // width, far // width + 1) if near <= far else ():
                        x, y = max(near, k * width), min(far, k * width + width - 1)
                        core, hull = piece[left - k * width : left - (k * width + width - 1) + size], piece[left - y : left - x + size]
                        key = hashlib.blake2b(core, digest_size=8, key=b"%d %d %d" % (grp, width, k)).digest()
                        dig = hashlib.blake2b(hull, digest_size=16, key=b"%d %d" % (x, y)).digest()
                        rows.append((int.from_bytes(key, "little", signed=True), dig, th, a, n, x, y))
                types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=["grp", "hull", "th", "a", "n", "near", "far"])

        return lean(run)

    large = large.select("grp", "th", "a", "n", "left", "piece")
    for kind, size in enumerate(lengths):
        rest = large
        for width in WIDTHS:
            name = f"{kind}-{width}"
            rows = write(rest.mapInArrow(split(kind, width), "grp long, hull binary, th binary, a int, n long, near int, far int"), f"suffix-split-{name}")
            hulls = write(rows.groupBy("grp", "hull").agg(F.sum("n").alias("n"), F.first(F.struct("th", "a", "near", "far")).alias("p")).select("grp", "hull", "n", "p.*"), f"suffix-hulls-{name}")
            whole = rows.where("n = 1").join(hulls.where("n > 1").select("grp", "hull"), ["grp", "hull"], "left_semi")
            marks.append(write(whole.select("th", F.lit(kind).alias("kind"), (F.col("a") - F.col("far")).alias("from"), (F.col("a") - F.col("near") + size).alias("to")), f"suffix-whole-{name}"))
            if width > 1:  # else the window itself is the string: nothing is left to sort
                m = write(hulls.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("grp", "m"), f"suffix-ranges-{name}")
                open_ = hulls.join(m, "grp").select("grp", "th", "a", "n", "m", "near", "far")
                bytes_ = F.expr(f"substring(piece, left - far + 1, {size} + far - near)")
                left = open_.join(large.select("th", "a", "left", "piece"), ["th", "a"]).select("grp", "th", "a", "n", "m", F.col("far").alias("left"), bytes_.alias("piece"))
                left = write(left, f"suffix-left-{name}")
                marks.append(sorted_marks(left, [kind]))
                rest = left.where(F.col("m") > most).select("grp", "th", "a", "n", "left", "piece")
            write.forget(rows, hulls)
            if width == 1 or rest.isEmpty():
                break
    return _union(marks)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NAMES = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def runs_of(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of packed ranges (from in the upper 32 bits, to in the lower)."""
    out: list[tuple[int, int]] = []
    for s in np.sort(spans).tolist():
        start, end = s >> 32, s & 0xFFFFFFFF
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST, passage: int | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, digest of what stays. With ``passage``, also the bytes and runs
    of repeated strings of that length (n_passage_bytes, n_passages); with ``with_text``, the kept bytes."""
    lengths = [length, *([passage] if passage else [])]
    text = F.coalesce(F.col(text_col), F.lit(""))
    spark, write = docs.sparkSession, Scratch(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("th"))
    members = materialise(src.select("doc_id", "th", F.octet_length("text").alias("size")), "suffix-members")
    # distinct texts lie in buckets by their digest, so that nothing that is joined to them later moves a text again
    size = members.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = tasks * (size // (TABLE_BYTES * tasks) + 1)
    distinct = src.groupBy("th").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = write.bucketed(distinct, "suffix-texts", "th", n)

    marks = repeated_marks(texts, write, lengths, gram, most)
    packed = F.shiftleft(F.col("from").cast("long"), 32) + F.col("to")
    spans = marks.groupBy("th").agg(*[F.collect_list(F.when(F.col("kind") == k, packed)).alias(f"spans{k}") for k in range(len(lengths))])  # two numbers an anchor of the text
    names = [*NAMES, *(["n_passage_bytes", "n_passages"] if passage else []), *(["kept"] if with_text else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.int64(), pa.int64()] if passage else []), *([pa.binary()] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                rows = []
                for t, copies, *lists in zip(*(b.column(c) for c in ("text", "copies", *(f"spans{k}" for k in range(len(lengths))))), strict=True):
                    raw = t.as_py().encode("utf-8", "surrogatepass")
                    own = [[(0, len(raw))] if copies.as_py() > 1 and len(raw) >= x else runs_of(s.values.to_numpy()) if s.is_valid and len(s) else [] for x, s in zip(lengths, lists, strict=True)]
                    ends = [0, *[y for _, y in own[0]]]
                    kept = b"".join([raw[p:q] for p, q in zip(ends, [*[x for x, _ in own[0]], len(raw)], strict=True)])
                    row = [len(raw), len(raw) - len(kept), len(own[0]), hashlib.sha256(kept).hexdigest()]
                    if passage:
                        row += [sum(y - x for x, y in own[1]), len(own[1])]
                    rows.append([*row, kept][: len(types)])
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([b.column("th"), *[pa.array(x, t) for x, t in zip(cols, types, strict=True)]], names=["th", *names])

    schema = "th binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_passage_bytes long, n_passages long" * bool(passage) + ", kept binary" * with_text
    judged = texts.join(write(spans, "suffix-spans"), "th", "left").select("th", "text", "copies", *[f"spans{k}" for k in range(len(lengths))])
    results = materialise(judged.mapInArrow(lean(run), schema), "suffix-results")
    write.drop()
    return members.join(results, "th").select("doc_id", *names)

"""Document fingerprints by randomised edit embedding.

All texts take the same random walk over their characters: at step j the
character under the pointer decides, by a random function shared by all
documents, which bit is put out and whether the pointer moves on. Texts a few
edits apart fall into step again after each edit, so edit distance becomes
Hamming distance. The walk restarts every SEGMENT characters, which bounds what
an edit that the walk is slow to recover from can cost, and lets numpy take one
step of many stretches at once. The stretches are cut at fixed places: an
insertion or deletion shifts all later ones, so in long texts its cost grows with
the text behind it. A fingerprint is a sample of the bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, mix64, range_split, shuffle_partitions
from .components import bucket_components

#: Characters after which the walk restarts, and its steps for each character.
SEGMENT, STEPS = 512, 3
#: Bits of a fingerprint (texts of fewer than BITS / STEPS characters have fewer).
BITS = 512
#: Share of unlike bits of unrelated texts: a third of the steps come after the
#: last character, and half of the others are alike by chance.
UNRELATED = 1 / 3
#: Bands of the near-duplicate search for each length that a text is filed under,
#: and the share of them that a pair at the limit of likeness has in common: it
#: misses all with probability (1 - SHARED)**BANDS, about 1e-4.
BANDS, SHARED = 128, 0.07

_WALK = np.random.default_rng(31).integers(0, 2**63, (2, SEGMENT * STEPS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MOVE, _SHOW = _WALK


@functools.lru_cache(maxsize=64)
def _lowest(octave: int) -> np.ndarray:
    """Of the steps below 2**octave those of lowest random priority, in its order:
    enough for BITS of them to lie below any number over half of that."""
    best = np.zeros(0, np.int64)
    for start in range(0, 1 << octave, 1 << 20):
        at = np.concatenate((best, np.arange(start, min(start + (1 << 20), 1 << octave))))
        best = at[np.argsort(mix64(at.astype(np.uint64)), kind="stable")[: 8 * BITS]]
    return best


def sampled_steps(n_chars: int) -> np.ndarray:
    """Which steps of a walk over ``n_chars`` characters a fingerprint shows, by
    priority: those of a shorter walk come first in a longer one's, as far as they go."""
    steps = STEPS * n_chars
    if steps == 0:
        return np.zeros(0, np.int64)
    order = _lowest(max(int(steps - 1).bit_length(), 1))
    return order[order < steps][:BITS]


def fingerprints(texts: list[str]) -> list[str]:
    """`length:bits`, both hexadecimal, of each whole text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    per_text = -(-sizes // SEGMENT)
    total = int(per_text.sum())
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    text_of = np.repeat(np.arange(len(texts)), per_text)
    inside = np.arange(total) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    length = np.minimum(SEGMENT, sizes[text_of] - inside * SEGMENT)
    # each stretch is followed by a zero, which neither moves the pointer nor shows a bit
    starts = np.cumsum(length + 1) - (length + 1)
    hashed = np.zeros(int((length + 1).sum()), np.uint64)
    hashed[np.arange(len(points)) + np.repeat(np.arange(total), length)] = mix64(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    shown = np.zeros((SEGMENT * STEPS, total), np.uint8)
    order = np.argsort(-length, kind="stable")  # short stretches leave the walk early
    pointer = starts[order]
    reach = length[order] * STEPS
    active = total
    for j in range(SEGMENT * STEPS):
        while active and reach[active - 1] <= j:
            active = int(np.searchsorted(-reach, -j, side="left"))
        if not active:
            break
        under = hashed[pointer[:active]]
        shown[j, :active] = (under * _SHOW[j]) >> np.uint64(63)
        pointer[:active] += ((under * _MOVE[j]) >> np.uint64(63)).astype(np.int64)
    column = np.empty(total, np.int64)
    column[order] = np.arange(total)
    first = np.cumsum(per_text) - per_text
    out = []
    for n, base in zip(sizes.tolist(), first.tolist(), strict=True):
        at = sampled_steps(n)
        bits = shown[at % (SEGMENT * STEPS), column[base + at // (SEGMENT * STEPS)]] if n else np.zeros(0, np.uint8)
        out.append(f"{n:x}:{np.packbits(bits).tobytes().hex()}")
    return out


def _parse(print_: str) -> tuple[int, np.ndarray]:
    n, _, digits = print_.partition(":")
    n = int(n, 16)
    return n, np.unpackbits(np.frombuffer(bytes.fromhex(digits), np.uint8))[: min(BITS, STEPS * n)]


def likeness(one: str, other: str) -> float:
    """1 for equal fingerprints, less the more characters were replaced, little for
    unrelated ones. Inserted or deleted characters count anew in every later SEGMENT."""
    if one == other:
        return 1.0
    (n, a), (m, b) = sorted((_parse(one), _parse(other)), key=lambda p: p[0])
    if n == 0:
        return 0.0
    common = sampled_steps(m) < STEPS * n
    k = int(common.sum())
    unlike = int((a[:k] != b[common]).sum()) + (len(b) - k) * UNRELATED
    return float(max(0.0, 1 - unlike / len(b) / UNRELATED))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) characters replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, against its edited text and the next document:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The next document is that of the next smaller id, after the smallest the one
    of the largest; rows of one id follow by text. Null texts are empty; rows of null ids are left out. Documents are
    dealt by ranges of ids; besides its range a task gets the first document of the
    next one, and only the ids of those come to the driver."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    parts = shuffle_partitions(spark)
    dealt = slim.withColumn("part", range_split(slim, "doc_id", parts, descending=True))
    heads = dict(dealt.groupBy("part").agg(F.max("doc_id").alias("head")).collect())
    held = sorted(heads)
    before = {p: held[k - 1] for k, p in enumerate(held)}  # the last range is before the first
    if held:
        back = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part"))
        tops = dealt.where(F.col("doc_id").isin(*sorted(heads.values())))
        least = tops.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("part").alias("part")).select("doc_id", "text", back.alias("part"), F.lit(True).alias("extra"))
        dealt = dealt.withColumn("extra", F.lit(False)).unionByName(least)
    else:
        dealt = dealt.withColumn("extra", F.lit(False))
    placed = dealt.repartitionById(parts, "part").sortWithinPartitions(F.asc("extra"), F.desc("doc_id"), F.asc("text"))

    def finish(ids: list[int], texts: list[str], following: str, following_print: str | None) -> tuple[pa.RecordBatch, str]:
        nexts = texts[1:] + [following]
        edited = [edited_text(a, b) for a, b in zip(texts, nexts, strict=True)]
        prints = fingerprints(texts + edited + ([following] if following_print is None else []))
        own, changed = prints[: len(texts)], prints[len(texts) : 2 * len(texts)]
        after = own[1:] + [following_print if following_print is not None else prints[-1]]
        import hashlib

        columns = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(own, pa.string()), pa.array(changed, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str] = []
        for batch in batches:
            for piece in chunks(batch, "text"):
                more = piece.column("text").to_numpy(zero_copy_only=False).tolist()
                extra = piece.column("extra").to_pylist()
                if texts and more:
                    yield finish(ids, texts, more[0], None)
                    ids, texts = [], []
                ids, texts = piece.column("doc_id").to_pylist(), more
                if extra[-1]:
                    if len(texts) > 1:
                        yield finish(ids[:-1], texts[:-1], texts[-1], None)
                    ids, texts = [], []
        if texts:
            raise AssertionError("a range of documents without its successor")

    return placed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _next_length(length: int) -> int:
    return max(length + 1, length * 9 // 8)


@functools.lru_cache(maxsize=64)
def _lengths(octave: int) -> list[int]:
    """The lengths below 2**octave that texts are filed under."""
    out = [1]
    while _next_length(out[-1]) < 1 << octave:
        out.append(_next_length(out[-1]))
    return out


def _longest(length: int, least: float) -> int:
    """No longer text is as like as ``least`` to one that is shorter than the next length.

    All steps that only the longer has count as unlike, so the shorter has
    ``least`` of the sampled ones; 0.1 is over four standard deviations of that share."""
    return int(_next_length(length) / max(least - 0.1, 0.05)) + 1


@functools.lru_cache(maxsize=4096)
def _drawn(length: int, least: float) -> tuple[int, np.ndarray]:
    """How many of the sampled steps over the first ``length`` characters all texts filed
    under it show, and which of them each band draws (with replacement)."""
    steps = sampled_steps(_longest(length, least))
    shown = int((steps < STEPS * length).sum())
    # unlike steps at the limit; a quarter more because they may crowd in the drawn ones
    unlike = min(1.25 * (1 - least) * UNRELATED, 0.5)
    each = min(64, max(1, int(np.log(SHARED) / np.log1p(-unlike)))) if unlike > 0 else 64
    draw = mix64(mix64(np.arange(BANDS * each, dtype=np.uint64) + np.uint64(77)) ^ np.uint64(length))
    return shown, (draw % np.uint64(shown)).astype(np.int64).reshape(BANDS, each)


def band_keys(print_: str, least: float = 0.8) -> list[int]:
    """Hashes of bands of bits, BANDS for each length that the text is filed under.

    Texts of likeness ``least`` or more have a length in common: the last that is
    no longer than the shorter one. A length's bands look only at steps that
    all texts filed under it show, whatever their own lengths."""
    n, bits = _parse(print_)
    at = sampled_steps(n)
    out = []
    for length in reversed(_lengths(n.bit_length())):
        if length > n:
            continue
        if n > _longest(length, least):
            break
        shown, drawn = _drawn(length, least)
        own = np.zeros((BANDS, 8), np.uint8)
        packed = np.packbits(bits[at < STEPS * length][:shown][drawn], axis=1)
        own[:, : packed.shape[1]] = packed
        name = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(length) * np.uint64(BANDS))
        out += mix64(own.view(np.uint64)[:, 0] ^ name).view(np.int64).tolist()
    return out


def edit_near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (smallest id reachable).

    Bit-sampled banding finds candidates (all but about 1e-4 of the pairs at
    ``least``, fewer of the closer ones), whole fingerprints verify them
    (likeness ``least`` or more). Equal fingerprints are one class and only one
    member of it is searched for; null and empty texts are alike; null ids are left out; of rows with one id the smallest text counts."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fingerprints(piece.column("text").to_pylist()), pa.string())], ["doc_id", "fingerprint"])

    signed = materialize(texts.mapInArrow(sign, "doc_id long, fingerprint string"), "editprints")
    reps = signed.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                keys = [band_keys(p, least) for p in part.column("fingerprint").to_pylist()]
                ids = np.repeat(np.asarray(part.column("rep"), np.int64), [len(own) for own in keys])
                yield pa.RecordBatch.from_arrays([pa.array([k for own in keys for k in own], pa.int64()), pa.array(ids)], ["band", "doc_id"])

    prints = materialize(reps, "editprint-classes")
    bands = prints.mapInArrow(spread, "band long, doc_id long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = [likeness(x, y) >= least for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
                keep = pa.array(near, pa.bool_())
                yield pa.RecordBatch.from_arrays([pc.filter(batch.column("a"), keep), pc.filter(batch.column("b"), keep)], ["a", "b"])

        left = pairs.join(prints.select(F.col("rep").alias("a"), F.col("fingerprint").alias("x")), "a")
        return left.join(prints.select(F.col("rep").alias("b"), F.col("fingerprint").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")

    groups = bucket_components(bands, confirmed, "editprint")
    member = signed.join(prints, "fingerprint")
    return member.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "fingerprint", F.coalesce("component", "rep").alias("component_id"))

"""Shortest-pack-first packing of tokenised documents over the length histogram.

1. Tokenise each text once (ids of the public 50k byte-level BPE, then the
   end id), cut it into pieces of at most ``max_len`` ids, and write only
   the pieces' figures (start, length, crc32): the ids themselves are not kept.
2. Place the histogram of piece lengths (at most ``max_len`` rows) on the
   driver: longest first, each into the open pack with most room; equal packs
   are one pattern with a count.
3. Join patterns back to pieces by (length, rank). Ranks come from counts per
   (length, hash bucket) and a row number inside each bucket, so a length that
   a third of all pieces share is spread over all buckets.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import materialize, require, shuffle_width

MAX_LEN = 1024
END_ID = 0
END_TEXT = "<|endoftext|>"
BUCKETS_PER_PARTITION = 8
_GROUP_CHARS = 4 << 20
_LONG = 400   # bytes of a chunk
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_EDGE = r"\A\z|\A[\s\v\x1c-\x1f\x{85}\p{Z}]|[\s\v\x1c-\x1f\x{85}\p{Z}]\z"
# The two libraries' classes of characters may differ on these, and only one knows the special token.
_ODD = r"[^\p{L}\p{N}\p{P}\p{S} \t\n\v\f\r]|" + re.escape(END_TEXT)
_encoders: dict[tuple[str, str], "Encoder"] = {}


def tokenizer_paths() -> tuple[str, str]:
    """The public vocabulary as tokenizers JSON and as ranks."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of ``tokenizers`` for the JSON vocabulary, as little-endian uint32.

    A byte-level BPE never merges across the start of a " word", so a space
    between two characters other than white space is a safe place to cut. Texts are
    cut at their spaces and the chunks dictionary-encoded, a group of texts at a
    time. A group's distinct chunks are encoded in one call with the same vocabulary's
    ranks, which is several times faster than ``tokenizers``, and told apart by the byte
    lengths of their ids. Chunks with unusual characters or the special token go
    to ``tokenizers``; a text in which a space touches other white space is cut at its
    safe spaces only.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import regex
        import tiktoken
        import public_tokenizers
        from tokenizers import Tokenizer
        self.odd = regex.compile(_ODD)
        self.whole = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})
        self.n_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.n_bytes[list(ranks.values())] = [len(x) for x in ranks]

    def _slowly(self, chunk: str) -> np.ndarray:
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, dtype="<u4")

    def _quickly(self, text: str) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")

    @staticmethod
    def _odd(chunks: pa.Array) -> np.ndarray:
        """Chunks for ``tokenizers``; among them long ones, whose merges take the rank encoder quadratic time."""
        unusual = pc.match_substring_regex(chunks, _ODD).to_numpy(zero_copy_only=False)
        return unusual | (pc.binary_length(chunks).to_numpy() > _LONG)

    def _table(self, chunks: pa.Array, lead: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(ids in parts, number of ids of each chunk, order of the chunks in the parts); ``lead`` stands before each."""
        odd = self._odd(chunks)
        words = chunks.to_numpy(zero_copy_only=False)
        size = np.zeros(len(words), dtype=np.int64)
        plain = np.flatnonzero(~odd)
        rest = [self._slowly(lead + words[k]) for k in np.flatnonzero(odd)]
        if lead:
            ids = self._quickly(lead + lead.join(words[plain])) if len(plain) else np.empty(0, dtype="<u4")
            lengths = pc.binary_length(chunks).to_numpy()[plain] + len(lead)
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(lengths)) + 1
            size[plain] = np.diff(ends, prepend=0)
            found = [ids]
        else:
            found = [self._quickly(w) for w in words[plain]]
            size[plain] = [len(x) for x in found]
        size[odd] = [len(x) for x in rest]
        return found + rest, size, np.concatenate((plain, np.flatnonzero(odd)))

    def _at_safe_spaces(self, text: str, inside: bool) -> np.ndarray:
        first, *rest = _SAFE_SPACE.split(text)
        chunks = ([" " + first if inside else first] if first else []) + [" " + c for c in rest]
        ids = [self._slowly(c) if len(c) * 4 > _LONG or self.odd.search(c) else self._quickly(c) for c in chunks]
        return np.concatenate([np.empty(0, dtype="<u4"), *ids])

    def _group(self, sections: list[tuple[str, bool]]) -> list[np.ndarray]:
        """Ids of sections of texts; the flag says that a space, cut away, stands before the section."""
        parts = pc.split_pattern(pa.array([s for s, _ in sections], pa.large_string()), " ")
        begin = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        code, chunks = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        # A chunk with white space at an end, or without a character, touches another space: no safe cut.
        unsafe = pc.match_substring_regex(chunks, _EDGE).to_numpy(zero_copy_only=False)
        loose = np.logical_or.reduceat(unsafe[code], begin[:-1])
        # Chunks at the start of a text have no space before them: codes of their own.
        head = begin[:-1][[not inside for _, inside in sections]]
        bare = np.unique(code[head])
        code[head] = len(chunks) + np.searchsorted(bare, code[head])
        safe, bare_safe = np.flatnonzero(~unsafe), np.flatnonzero(~unsafe[bare])
        size, place = np.zeros((2, len(chunks) + len(bare)), dtype=np.int64)
        tables, at = [], 0
        for lead, of, number in ((" ", safe, safe), ("", bare[bare_safe], len(chunks) + bare_safe)):
            ids, n, order = self._table(chunks.take(pa.array(of)), lead)
            size[number] = n
            place[number[order]] = at + np.cumsum(n[order]) - n[order]
            at += int(n.sum())
            tables += ids
        taken = size[code]
        end = np.cumsum(taken)
        flat = np.concatenate(tables)
        out = flat[np.repeat(place[code] - (end - taken), taken) + np.arange(end[-1])]
        cuts = np.concatenate(([0], end[begin[1:] - 1]))
        return [self._at_safe_spaces(*sections[k]) if loose[k] else out[cuts[k]:cuts[k + 1]]
                for k in range(len(sections))]

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text in turn; a long text goes by sections that end at a safe space."""
        group: list[tuple[str, bool]] = []
        counts: list[int] = []   # sections of each waiting text
        size = 0

        def flush() -> Iterator[np.ndarray]:
            found = iter(self._group(group)) if group else iter(())
            for n in counts:
                own = [next(found) for _ in range(n)]
                yield own[0] if n == 1 else np.concatenate(own)
            group.clear()
            counts.clear()

        for text in texts:
            at, n = 0, 0
            while True:
                cut = _SAFE_SPACE.search(text, at + _GROUP_CHARS) if len(text) - at > _GROUP_CHARS else None
                group.append((text[at:cut.start()] if cut else text[at:], at > 0))
                n += 1
                if not cut:
                    break
                at = cut.end()
            counts.append(n)
            size += len(text) + 1
            if size >= _GROUP_CHARS:
                yield from flush()
                size = 0
        yield from flush()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text])).tobytes()


def _encoder(paths: tuple[str, str]) -> Encoder:
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN,
                 paths: tuple[str, str] | None = None) -> DataFrame:
    """Rows (``id_col``, start, length, ids_crc32, doc_tokens): each text's ids and the end id, cut every ``max_len``."""
    paths = paths or tokenizer_paths()
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = _encoder(paths), np.array([END_ID], dtype="<u4")
        for batch in batches:
            at, starts, lengths, sums, totals = [], [], [], [], []
            for row, own in enumerate(enc.encode_all(text or "" for text in batch["text"])):
                ids = np.concatenate((own, end))
                total = len(ids)
                for start in range(0, total, max_len):
                    piece = ids[start:start + max_len]
                    at.append(row)
                    starts.append(start)
                    lengths.append(len(piece))
                    sums.append(zlib.crc32(piece))
                    totals.append(total)
            yield pd.DataFrame({id_col: batch["id"].iloc[at].reset_index(drop=True), "start": starts,
                                "length": lengths, "ids_crc32": sums, "doc_tokens": totals})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(cut, schema)


def shortest_pack_first(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, tuple[int, ...]]]:
    """Pattern counts [(count, lengths)] for a histogram {length: count}.

    Lengths go longest first; each item goes to the open pack with most room
    (the shortest), a new pack only when none has room. Packs of equal
    content are one entry, so the work follows the distinct lengths, not the
    number of pieces.
    """
    open_packs: list[dict[tuple[int, ...], int]] = [{} for _ in range(max_len + 1)]  # by room left
    top = 0

    def put(pack: tuple[int, ...], n: int) -> None:
        nonlocal top
        if n:
            room = max_len - sum(pack)
            open_packs[room][pack] = open_packs[room].get(pack, 0) + n
            top = max(top, room)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= max_len:
            raise ValueError(f"length {length} is outside 1..{max_len}")
        todo = histogram[length]
        while todo > 0:
            while top and not open_packs[top]:
                top -= 1
            if top < length:
                # No pack has room: each new one takes as many as fit before the next is opened.
                many, rest = divmod(todo, max_len // length)
                put((length,) * (max_len // length), many)
                put((length,) * rest, 1 if rest else 0)
                break
            pack, have = open_packs[top].popitem()
            n = min(have, todo)
            if have > n:
                open_packs[top][pack] = have - n
            put((*pack, length), n)
            todo -= n
    return [(n, pack) for packs in open_packs for pack, n in packs.items()]


def pattern_slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): which ranks of a length fill which place of a pattern."""
    slots, used, sequence = [], {}, 0
    for count, pack in patterns:
        offset = 0
        for length in pack:
            rank = used.get(length, 0)
            slots.append((length, rank, rank + count, sequence, offset))
            used[length] = rank + count
            offset += length
        sequence += count
    return slots


def ranked_by_length(pieces: DataFrame, id_col: str, buckets: int) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, ... within each length, without a task per length."""
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64(id_col, "start"), F.lit(buckets)))
    before = (Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy("length", "bucket").orderBy(id_col, "start", "doc_tokens", "ids_crc32")
    return (spread.withColumn("at", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"])
            .withColumn("rank", F.col("base") + F.col("at")).drop("bucket", "base", "at"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN,
         paths: tuple[str, str] | None = None) -> DataFrame:
    """Pieces with their place: (``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every row of ``docs`` is packed, repeated rows each for themselves; NULL
    and empty texts are the end id alone; a NULL id is kept as it is. Texts
    longer than a sequence are cut every ``max_len`` ids. Other columns are
    not read. An empty table gives no rows.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, id_col, text_col, max_len, paths), "pack-pieces")
    # At most max_len rows, whatever the corpus.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = pattern_slots(shortest_pack_first(histogram, max_len))
    # The slots are bounded by max_len (patterns grow by at most one a length, items by max_len a pattern).
    places = F.broadcast(spark.createDataFrame(
        slots, "length long, first_rank long, end_rank long, first_sequence long, offset long"))
    ranked = ranked_by_length(pieces, id_col, BUCKETS_PER_PARTITION * shuffle_width(spark))
    on = ((ranked["length"] == places["length"]) & (ranked["rank"] >= places["first_rank"])
          & (ranked["rank"] < places["end_rank"]))
    return (ranked.join(places, on).drop(places["length"])
            .withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank"))
            .select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))

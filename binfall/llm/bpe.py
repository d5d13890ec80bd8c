"""BPE encoding and decoding with content-defined chunk reuse.

Every text is cut after spaces at which a rolling hash of the code points before it hits a mask, so equal passages of different
documents are cut at equal places. Each distinct chunk is encoded once per worker and kept in a bounded table. A chunk is put together
from its space-separated pieces, which recur far more often than chunks; where a mark, a control or odd white space stands
beside a space in it, the two pieces are encoded together too and merged if that gives other ids.

Chunk joins are then tried: the last piece of a chunk and the first of the next are encoded together, and if the ids differ from the joined
ids, the two chunks are encoded as one and the next join is tried with that, until all agree. Tried joins are kept in a bounded table.

All of this needs a tokenizer that drops spaces and does not look across them. Probes decide that when a tokenizer is loaded, as they
do whether it lowers case and parts words from signs; with any other tokenizer, and for texts that hold a special token's
string, texts are encoded whole.

Edge cases: null is the empty text (no ids); a very long text is cut like others, its ids are held by one task; rows are independent, so ties,
repeated rows, null ids and empty tables need no rule; extra columns pass through.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: One chunk ends at about every sixty-fourth space.
CHUNK_MASK = 63
#: Entries of the tables of a worker; a full table is emptied.
CHUNKS, PIECES, JOINS = 5_000, 300_000, 40_000
#: What a tokenizer is probed with: pieces that must come out alike alone and beside others.
PROBES = ("a", "the", "word", "Xy", "12", "7", "it's", "...", "-", "(b)", "\u00e9t\u00e9", "\u4e2d\u6587", "q\u00fc", "_", "'s", "3rd")
#: Marks, controls, white space other than the plain space, and the letter whose lower case depends on what follows it:
#: a normaliser might look past a space beside one of them.
DOUBTFUL = regex.compile(r"[\p{M}\p{C}\p{Zl}\p{Zp}\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\u03a3]")
#: The place between an ASCII letter or digit and an ASCII sign other than the apostrophe.
SIGN_AFTER_WORD = re.compile(r"(?<=[A-Za-z0-9])(?=[!-&(-/:-@\[-`{-~])")
_TABLE = np.random.default_rng(9).integers(0, 1 << 32, 256, dtype=np.uint64)


def cuts(text: str) -> list[int]:
    """Character positions after which a chunk ends: spaces whose eight preceding code points hash to the mask."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashed = _TABLE[points & 255]
    rolling = np.zeros(len(points), np.uint64)
    for back in range(1, 9):
        rolling[back:] += hashed[:-back] << np.uint64(back) if back < len(points) else 0
    at = np.flatnonzero(points == 32)
    return (at[(rolling[at] >> np.uint64(7)) & np.uint64(CHUNK_MASK) == 0] + 1).tolist()


class ChunkEncoder:
    """Encodes texts as the library would, reusing chunks. ids are kept as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        self.joins: dict[tuple[str, str], bool] = {}
        self.repairs = 0
        self.mark = self.tokenizer.token_to_id(self.special[-1]) if self.special else None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = np.array([self.tokenizer.id_to_token(i) or "" for i in range(size)], object)
        alike = lambda pairs: all(x == y for x, y in zip(self.plain([p[0] for p in pairs]), self.plain([p[1] for p in pairs]), strict=True))
        alone = dict(zip(PROBES, self.plain(list(PROBES)), strict=True))
        both = [(x, y) for x in PROBES for y in PROBES]
        self.spaced = all(ids == alone[x] + alone[y] for (x, y), ids in zip(both, self.plain([f"{x} {y}" for x, y in both]), strict=True)) and alike([("a  b", "a b"), ("a\nb", "a b"), (" a ", "a")])
        self.lowers = alike([(x.upper(), x) for x in ("abcdefghij", "klmnopqrst", "uvwxyz", "the word")])
        self.parts = alike([(f"{x}{s}{y}", f"{x} {s}{y}") for s in map(chr, range(33, 127)) if SIGN_AFTER_WORD.search(f"a{s}") for x in ("ab", "Z", "7") for y in ("", "cd", "5", s)])

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> None:
        """Encode the chunks that are not in the table yet."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.chunks]
        split = [c.split(" ") for c in new]
        self.known({p for s in split for p in s})
        if len(self.chunks) + len(new) > CHUNKS:
            used = set(chunks)
            self.chunks = {k: v for k, v in self.chunks.items() if k in used}
        for chunk, parts in zip(new, split, strict=True):
            plain = chunk.isascii() and chunk.isprintable() or not DOUBTFUL.search(chunk)
            self.chunks[chunk] = b"".join(map(self.pieces.__getitem__, parts)) if plain else self.joined(parts)

    def try_joins(self, pairs: set[tuple[str, str]]) -> None:
        """Encode each pair of pieces together, and note whether that gives the ids of the pieces."""
        new = [p for p in pairs if p not in self.joins]
        if len(self.joins) + len(new) > JOINS:
            self.joins, new = {}, list(pairs)
        self.known({piece for p in new for piece in p})
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for (x, y), ids in zip(some, self.apart([f"{x} {y}" for x, y in some]), strict=True):
                self.joins[x, y] = ids == self.pieces[x] + self.pieces[y]

    def known(self, pieces: set[str]) -> None:
        missing = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(missing) > PIECES:
            self.pieces, missing = {"": b""}, [p for p in pieces if p]
        for at in range(0, len(missing), 4096):
            some = missing[at : at + 4096]
            self.pieces.update(zip(some, self.apart(some), strict=True))

    def apart(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, from one call: a special token between two pieces keeps them apart and marks their ends."""
        if self.mark is None:
            return self.plain(pieces)
        ids = np.asarray(self.tokenizer.encode_batch_fast([self.special[-1].join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]

    def joined(self, parts: list[str]) -> bytes:
        """Ids of the pieces with a space between each two; every join beside a doubtful character is tried and repaired."""
        self.known(set(parts))
        done, last, ids = [], "", b""
        for p in parts:
            own = self.pieces[p]
            if last and p and not self.joins.get((last, p)) and (DOUBTFUL.match(last[-1]) or DOUBTFUL.match(p[0])):
                both = self.plain([f"{last} {p}"])[0]
                if both != ids + own:
                    self.repairs += 1
                    last, ids = f"{last} {p}", both
                    continue
            done.append(ids)
            last, ids = p, own
        return b"".join(done) + ids

    def repaired(self, chunks: list[str], ends: list[tuple[str, str]]) -> bytes:
        """Ids of the chunks, those whose join fails encoded as one."""
        done, text, ids = [], chunks[0], self.chunks[chunks[0]]
        for chunk, pair in zip(chunks[1:], ends, strict=True):
            if self.joins.get(pair, True):
                done.append(ids)
                text, ids = chunk, self.chunks[chunk]
            else:
                self.repairs += 1
                text = f"{text} {chunk}"
                ids = self.plain([text])[0]
        return b"".join(done) + ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.spaced:
            return self.plain(texts)
        out: list[bytes | None] = [None] * len(texts)
        cut: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = self.plain([text])[0]
                continue
            text = text.replace("\n", " ")
            ascii_ = text.isascii()
            if ascii_ and text.isprintable() or not DOUBTFUL.search(text):
                # what the tokenizer does anyway is done first, so fewer pieces differ
                text = text.lower() if ascii_ and self.lowers else text
                text = SIGN_AFTER_WORD.sub(" ", text) if self.parts else text
            at = [0, *cuts(text), len(text) + 1]
            cut[i] = [text[a : b - 1] for a, b in zip(at, at[1:], strict=False)]
        self.learn([c for chunks in cut.values() for c in chunks])
        # the pieces at both sides of every chunk join
        ends = {i: [(x[x.rfind(" ") + 1 :], y.partition(" ")[0]) for x, y in zip(chunks, chunks[1:], strict=False)] for i, chunks in cut.items()}
        self.try_joins({pair for pairs in ends.values() for pair in pairs if pair[0] and pair[1]})
        for i, chunks in cut.items():
            if all(self.joins.get(pair, True) for pair in ends[i]):
                out[i] = b"".join(map(self.chunks.__getitem__, chunks))
            else:
                out[i] = self.repaired(chunks, ends[i])
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        if self.tokenizer.decoder is None:  # then the library puts a space between tokens
            return [" ".join(self.tokens[np.frombuffer(x, "<u4")].tolist()) for x in ids]
        return self.tokenizer.decode_batch([np.frombuffer(x, "<u4").tolist() for x in ids], skip_special_tokens=False)


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker, so that its tables serve all of them and exist once."""
    return ChunkEncoder(path)


def _batches(column: pa.Array, rows: int = 256) -> Iterator[list[str]]:
    for at in range(0, len(column), rows):
        yield ["" if x is None else x for x in column.slice(at, rows).to_pylist()]


#: Columns that encode() adds, by name.
ADDED = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType(), False),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode(docs: DataFrame, path: str, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), add: tuple[str, ...] = tuple(ADDED)) -> DataFrame:
    """The columns in ``carry`` and those in ``add``: n_tokens, ids, decoded, and the digests of the ids (little-endian
    unsigned 32-bit) and of the decoded text (UTF-8). ``path`` is the tokenizer's file, readable on every executor."""
    frame = docs.select(*carry, docs[text].alias("__text"))
    schema = T.StructType([*frame.schema.fields[:-1], *(T.StructField(a, ADDED[a]) for a in add)])
    kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    decodes = any(a.startswith("decoded") for a in add)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in batches:
            at = 0
            # small batches go out as they are made, so ids never pile up
            for texts in _batches(batch.column(len(carry))):
                ids = encoder.encode(texts)
                decoded = encoder.decode(ids) if decodes else []
                made = {
                    "n_tokens": lambda: [len(x) // 4 for x in ids],
                    "ids": lambda: [np.frombuffer(x, "<i4") for x in ids],
                    "decoded": lambda: decoded,
                    "ids_sha256": lambda: [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": lambda: [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded],
                }
                kept = [c.slice(at, len(texts)) for c in batch.columns[: len(carry)]]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(made[a](), kinds[a]) for a in add)], names=schema.names)

    return frame.mapInArrow(run, schema)

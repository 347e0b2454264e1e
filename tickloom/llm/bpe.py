"""BPE encoding through a table of distinct words, and decoding through the table of pieces.

Documents are cut at ASCII white space, which this tokenizer family drops and never joins across, so
that the ids of a text are the ids of its words in a row. Each distinct word is encoded once, by the
tokenizers library, in its hash part of the word table; the ids are put back by position.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.chunks import answer, ask, meet, pack, parts, squeeze, unpack, unsqueeze
from tickloom.llm.common import tidy

#: Rows decoded at a time, which bounds what a worker holds.
DECODE_ROWS = 500
#: Bytes of text in a chunk; several times that is held while its ids are put in place.
CHUNK_BYTES = 6_000_000


def number_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words in order of appearance, the number of each word in turn, and the words per text."""
    place: dict[bytes, int] = {}
    codes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.split()
        counts[i] = len(words)
        codes.append(np.fromiter([place.setdefault(w, len(place)) for w in words], np.int32, len(words)))
    return list(place), np.concatenate(codes) if codes else np.zeros(0, np.int32), counts


def by_part(words: list[bytes], n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words by part, and where each part starts in it."""
    part = np.fromiter((zlib.crc32(w) % n_parts for w in words), np.int64, len(words))
    return np.argsort(part, kind="stable"), np.searchsorted(np.sort(part), np.arange(n_parts + 1))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, ids (array of int), one per input row: the whole text as the tokenizer's own ``encode`` has it without special tokens added.

    ``tokenizer_path``: a tokenizers file whose pre-tokenizer drops white space; read on the driver
    and sent along. A null or empty text has no ids. Rows with equal ids or texts are kept apart; a
    null id stays null; an empty table gives an empty table. Columns beside the two named are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    n_parts = parts(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = pack(source, CHUNK_BYTES)

    def request(data: bytes) -> Iterator[tuple[int, bytes]]:
        words, _, _ = number_words(unpack(data)[1])
        order, starts = by_part(words, n_parts)
        for part in np.flatnonzero(np.diff(starts)).tolist():
            yield part, squeeze(b"\n".join(words[i] for i in order[starts[part] : starts[part + 1]].tolist()))

    def resolve(payloads: list[bytes]) -> list[bytes]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        asked = [unsqueeze(p).split(b"\n") for p in payloads]
        place = {w: i for i, w in enumerate(dict.fromkeys(w for words in asked for w in words))}
        words = list(place)
        ids: list[np.ndarray] = []
        for i in range(0, len(words), 20_000):
            batch = tokenizer.encode_batch([w.decode() for w in words[i : i + 20_000]], add_special_tokens=False)
            ids += [np.array(e.ids, np.uint32) for e in batch]
        replies = []
        for one in asked:
            mine = [ids[place[w]] for w in one]
            lengths = np.array([len(x) for x in mine], np.uint32)
            replies.append(squeeze(lengths.tobytes() + np.concatenate(mine).tobytes()))
        return replies

    def finish(data: bytes, replies: dict[int, bytes]) -> pa.Table:
        doc_ids, texts = unpack(data)
        words, codes, counts = number_words(texts)
        order, starts = by_part(words, n_parts)
        lengths, pool, base = np.zeros(len(words), np.int64), [], np.zeros(len(words), np.int64)
        at = 0
        for part in np.flatnonzero(np.diff(starts)).tolist():
            mine = order[starts[part] : starts[part + 1]]
            reply = np.frombuffer(unsqueeze(replies[part]), np.uint32)
            own, ids = reply[: len(mine)].astype(np.int64), reply[len(mine) :]
            lengths[mine] = own
            base[mine] = at + np.cumsum(own) - own
            pool.append(ids)
            at += len(ids)
        flat = np.concatenate(pool) if pool else np.zeros(0, np.uint32)
        per_word = lengths[codes]
        ends = np.cumsum(per_word)
        id_ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        places = np.repeat((base[codes] - (ends - per_word)).astype(np.int32), per_word)
        places += np.arange(len(places), dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(id_ends, pa.int32()), pa.array(flat[places].view(np.int32)))
        return pa.table([doc_ids, ids], names=["doc_id", "ids"])

    answers = answer(ask(chunks, request), resolve)
    kind = source.schema["doc_id"].dataType.simpleString()
    return meet(chunks, answers, finish, f"doc_id {kind}, ids array<int>")


def pieces(tokenizer_path: str) -> list[str | None]:
    """The piece of each id, null for ids not in use: at most as long as the vocabulary."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    known = {i: piece for piece, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    return [known.get(i) for i in range(max(known, default=-1) + 1)]


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, as ``decode(ids, skip_special_tokens=False)`` of a tokenizer without a decoder.

    The ids of a batch are joined with the table of pieces (whose size the vocabulary bounds), then the
    pieces of a row with single spaces. Ids without a piece are left out; no ids, or null, give an empty text.
    A column that already has the name ``out_col`` is replaced.
    """
    table = pieces(tokenizer_path)
    encoded = encoded.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = pa.array(table, pa.string())

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = pc.fill_null(batch.column(batch.schema.get_field_index(ids_col)), pa.scalar([], pa.list_(pa.int32())))
            ids, owner = lists.flatten(), pc.list_parent_indices(lists)
            known = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(table)))
            found = by_id.take(pc.if_else(known, ids, None))
            keep = found.is_valid()
            found, owner = found.filter(keep), owner.filter(keep).to_numpy()
            offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found), " ")
            return pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, out_col])

        for batch in batches:
            for start in range(0, batch.num_rows, DECODE_ROWS):
                yield work(batch.slice(start, DECODE_ROWS))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(tidy(run), f"{fields}, `{out_col}` string")

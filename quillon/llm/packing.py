"""Vector bin packing of token pieces into sequences under limits on tokens, segments and loss-bearing tokens.

A document's first line is its prompt (a text of one line has none): ids up to the first one
that holds a newline bear no loss, nor does the end id; all others do. Documents are cut into
pieces from the start on, each as long as the limits on tokens and loss allow. Then a bin
takes, again and again, the piece with the largest dot product of its demand and the bin's
free room (each as a share of its limit) among the pieces that fit. Pieces of equal demand
are one type; types are looked at from the largest on, in blocks, until no later one can do
better, so that a choice costs few of them.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.spark_util import Scratch, documents, parts_for
from quillon.llm.tokens import encoded

TOKENS, SEGMENTS, LOSS = 1024, 32, 1008
GROUP = 20_000  # pieces that are packed together
_BLOCK = 512  # types that are looked at together
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long"


def place(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, order in the bin) of each piece; demand has a row per piece and a column per limit.

    A piece alone over a limit gets a bin of its own. Ties go to the type with the larger
    first demand, then the next, and to pieces in the order given."""
    n = len(demand)
    bins, order = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    over = (demand > limits).any(axis=1)
    bins[over] = np.arange(over.sum())
    used = int(over.sum())
    rest = np.flatnonzero(~over)
    if not len(rest):
        return bins, order
    types, kind = np.unique(-demand[rest], axis=0, return_inverse=True)
    types, kind = -types, kind.ravel()
    by = np.argsort(kind, kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=len(types)))
    at = ends - np.diff(ends, prepend=0)  # next piece of each type, of rest[by]
    pieces = rest[by]

    def columns():
        """By column: demands, shares of the limits, and the largest share in each block and all later ones."""
        share = np.ascontiguousarray((types / limits).T)
        most = np.maximum.reduceat(share, np.arange(0, len(types), _BLOCK), axis=1)
        return np.ascontiguousarray(types.T), share, np.maximum.accumulate(most[:, ::-1], axis=1)[:, ::-1].T.copy(), -types[:, 0]

    demands, share, most, falling = columns()
    live = np.ones(len(types), bool)
    while len(types):
        free, k = limits.astype(np.int64).copy(), 0
        while True:
            room = free / limits
            lo = int(falling.searchsorted(-free[0]))  # larger ones don't fit
            best, score = -1, -1.0
            for b in range(lo // _BLOCK, len(most)):
                if most[b] @ room <= score:
                    break
                part = slice(max(lo, b * _BLOCK), (b + 1) * _BLOCK)
                fits = live[part].copy()
                own = share[0, part] * room[0]
                for c in range(1, len(limits)):
                    fits &= demands[c, part] <= free[c]
                    own += share[c, part] * room[c]
                own[~fits] = -1.0
                if len(own) and own[j := int(own.argmax())] > score:
                    best, score = part.start + j, own[j]
            if best < 0:
                break
            piece = pieces[at[best]]
            at[best] += 1
            live[best] = at[best] < ends[best]
            bins[piece], order[piece] = used, k
            free -= types[best]
            k += 1
        if not k:
            break
        used += 1
        if used % 256 == 0 and 3 * np.count_nonzero(live) < 2 * len(types):
            types, at, ends = types[live], at[live], ends[live]
            live = np.ones(len(types), bool)
            if len(types):
                demands, share, most, falling = columns()
    return bins, order


def _newlines(path: str) -> np.ndarray:
    """Whether an id's token holds a newline, by what the tokenizer decodes it to."""
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    n = tool.get_vocab_size(True)
    return np.array(["\n" in t for t in tool.decode_batch([[i] for i in range(n)], skip_special_tokens=False)])


def _cuts(size: np.ndarray, prompt: np.ndarray, tokens: int, loss: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of each piece, by document and start; the last id of a document and its prompt bear no loss."""
    doc, start, found = np.arange(len(size)), np.zeros(len(size), np.int64), []
    while len(doc):
        n = size[doc]
        stop = np.minimum(start + tokens, np.maximum(start, prompt[doc]) + loss)
        stop = np.minimum(stop + (stop == n - 1) * (stop < start + tokens), n)  # the end id itself
        found.append((doc, start, stop - start))
        on = stop < n
        doc, start = doc[on], stop[on]
    doc, start, length = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((),) * 3))
    by = np.lexsort((start, doc))
    return doc[by], start[by], length[by]


def cut_pieces(path: str, tokens: int = TOKENS, end: int = 0, loss: int = LOSS):
    """Pieces of (doc_id, text) from the start on, each as long as the limits allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        newline = _newlines(path)
        for batch in batches:
            docs = np.asarray(batch.column(0).fill_null(-1))
            null = np.asarray(batch.column(0).is_null())
            for d, e, ids, cuts in encoded(batch.column(1), path, end):
                size = np.diff(cuts)
                lines = np.flatnonzero(newline[ids])
                lines = np.append(lines, len(ids))[np.searchsorted(lines, cuts[:-1])]  # first newline from each start on
                prompt = np.where(lines < cuts[1:] - 1, lines + 1 - cuts[:-1], 0)
                doc, start, length = _cuts(size, prompt, tokens, loss)
                data = memoryview(ids.astype("<u4").tobytes())
                a = (cuts[doc] + start) * 4
                crc = [zlib.crc32(data[x:y]) for x, y in zip(a.tolist(), (a + length * 4).tolist(), strict=True)]
                bears = np.maximum(0, np.minimum(start + length, size[doc] - 1) - np.maximum(start, prompt[doc]))
                yield pa.RecordBatch.from_arrays([pa.array(docs[d:e][doc], pa.int64(), mask=null[d:e][doc]), *(pa.array(x, pa.int64()) for x in (start, length, crc, size[doc], bears))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens"])

    return run


def pack(scratch: Scratch, pieces: DataFrame, limits: dict[str, int], group: int = GROUP) -> DataFrame:
    """pieces plus sequence_id (from 0, no gaps) and offset (gapless from 0 in each sequence).

    limits: column -> limit; the first column is what offset adds up. A limit on the column
    "segments" counts pieces. Pieces are dealt to groups by hash, each packed by itself; a
    group has about `group` pieces whatever the input's size."""
    columns = [c for c in limits if c != "segments"]
    bound = np.array(list(limits.values()), np.int64)
    names, key = pieces.columns, [c for c in ("doc_id", "start") if c in pieces.columns]
    n = parts_for(pieces.count(), group)
    schema = f"{pieces._jdf.schema().toDDL()}, gid int, local long, offset long"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in key])
        demand = np.stack([np.ones(len(table), np.int64) if c == "segments" else table[c].fill_null(0).to_numpy() for c in limits], axis=1)
        bins, order = place(demand, bound)
        by = np.lexsort((order, bins))
        size = demand[by, list(limits).index(columns[0])]
        total = np.cumsum(size) - size
        head = np.concatenate([[True], bins[by][1:] != bins[by][:-1]])
        offset = np.empty(len(by), np.int64)
        offset[by] = total - np.repeat(total[head], np.diff(np.append(np.flatnonzero(head), len(by))))
        return table.append_column("local", pa.array(bins)).append_column("offset", pa.array(offset)).select([*names, "gid", "local", "offset"])

    spread = pieces.withColumn("gid", F.pmod(F.xxhash64(*names), F.lit(n)).cast("int"))  # all columns: rows of one id are dealt out too
    packed = scratch.keep(spread.groupBy("gid").applyInArrow(run, schema), "packed")
    scratch.drop("pieces")
    before = packed.groupBy("gid").agg((F.max("local") + 1).alias("bins"))
    before = before.select("gid", (F.sum("bins").over(Window.orderBy("gid")) - F.col("bins")).alias("before"))
    return packed.join(before, "gid").select(*names, (F.col("before") + F.col("local")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, end: int = 0) -> DataFrame:
    """Each document's ids and the end id, in pieces, placed in sequences of at most `tokens`.

    A null or empty text is the end id alone. Repeated rows are packed each by itself; a null
    doc_id stays null. An empty table gives an empty result. Sequences are padded to `tokens`,
    but not where their length is a power of two. loss_tokens is a piece's loss-bearing ids."""
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.keep(plain.mapInArrow(cut_pieces(path, tokens, end, loss), PIECE), "pieces")
    return pack(scratch, pieces, {"length": tokens, "segments": segments, "loss_tokens": loss})


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

"""Token counts by finite-state tokenizer compilation.

A piece vocabulary is compiled to a deterministic transducer.  A state is the
open segment, the text since the last position that no vocabulary piece can
cross; the initial state has none.  Reading a character either extends the segment
and emits 0 or, at such a cut, emits the closed segment's token count and goes to
the state of the character alone; a state's final output is its own segment's
count.  Most texts' segments are met once, so states get no numbers: what is
compiled and kept are macro-transitions, segments to the count that their end
emits, and words between spaces, which are entered through their space mark, where
every state but the initial one is left.

Long texts are read in chunks, cut wherever the size says, inside words too.  A
chunk's map takes the state in which it is entered to the count emitted and the
state in which it is left; as every word start resets the state, the map is held
as (head, count, tail): the text before the first reset, whose count depends on the
entering state, the tokens emitted between resets, and the text after the last
one, which is the state it leaves.  Composition is associative, so maps are
combined by a parallel prefix scan's tree instead of one pass that carries the state.

Null and empty texts have no tokens.  Repeated rows each return a row.
"""

from __future__ import annotations

import functools
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

CHUNK = 1 << 16
TOKEN_LIMIT = 4096
MARK = "▁"


class CountTransducer:
    """Counts tokens of a byte-fallback BPE piece model."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        if any(pair[1] == MARK and pair[0] != MARK for pair in inside):
            raise ValueError("pieces of this model cross word starts; words are not macro-transitions")
        self.inside = inside
        self.longest = max(map(len, self.score))
        self.segments = common.Memo(self.merge, 400_000, "op5")
        self.words = common.Memo(lambda w: self.run(MARK + w), 500_000, "op5")

    def run(self, text: str) -> int:
        """Read text from the initial state and close its last segment."""
        inside, total, start = self.inside, 0, 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in inside:
                total += self.segments[text[start:i]]
                start = i
        return total + (self.segments[text[start:]] if text else 0)

    def merge(self, segment: str) -> int:
        """Tokens of one segment: best score first, leftmost among equals."""
        score, n = self.score, len(segment)
        if segment in score and n == 1:
            return 1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        end = list(range(1, n + 1))  # end[i] = 0: merged away
        heap = [(-s, i, i + 2) for i in range(n - 1) if (s := score.get(segment[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if not end[i] or j >= n or end[j] != stop or not end[j]:
                continue
            end[i], end[j] = stop, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if end[k] - i <= self.longest and (s := score.get(segment[i : end[k]])) is not None:
                    heapq.heappush(heap, (-s, i, end[k]))
            h = before[i]
            if h >= 0 and stop - h <= self.longest and (s := score.get(segment[h:stop])) is not None:
                heapq.heappush(heap, (-s, h, stop))
        total = i = 0
        while i < n:
            piece = segment[i : end[i]]
            total += 1 if piece in score else len(piece.encode())
            i = after[i]
        return total

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, emitted, tail); emitted is None while the chunk has no word start."""
        words = chunk.split(" ")
        if len(words) < 3:
            return chunk, None, ""
        first = next((i for i in range(1, len(words)) if words[i - 1]), None)
        last = next((i for i in range(len(words) - 1, 0, -1) if words[i - 1]), None)
        if first is None or last is None or last <= first:
            return chunk, None, ""
        return " ".join(words[:first]), self.between(words[first:last]), " " + " ".join(words[last:])

    def between(self, words: list[str]) -> int:
        """Words that each follow a space; an empty one is a further space before the next."""
        if "" not in words:
            return sum(map(self.words.__getitem__, words))
        total, spaces = 0, 0
        for w in words:
            if not w:
                spaces += 1
            elif spaces:
                total += self.run(MARK * (spaces + 1) + w)
                spaces = 0
            else:
                total += self.words[w]
        return total + (self.run(MARK * spaces) if spaces else 0)

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None and b[1] is None:
            return self.chunk_map(a[0] + b[0]) if len(a[0]) + len(b[0]) < 4 * CHUNK else (a[0] + b[0], None, "")
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.close(a[2] + b[0]) + b[1], b[2]

    def close(self, text: str) -> int:
        """Tokens of a stretch that begins at a word start."""
        return self.between(text[1:].split(" ")) if text else 0

    def scan(self, maps: list[tuple]) -> tuple:
        """Reduce by the balanced tree of a parallel prefix scan."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str) -> int:
        """Tokens of a whole text, with the model's leading space mark."""
        if not text:
            return 0
        text = " " + text.replace(MARK, " ")
        if len(text) <= CHUNK:
            return self.close(text)
        head, mid, tail = self.scan([self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])
        return self.close(head) + (mid or 0) + self.close(tail)


@functools.lru_cache(maxsize=2)
def transducer(model_path: str) -> CountTransducer:
    return CountTransducer(model_path)


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, model_path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per row of docs: bytes, tokens, and whether tokens exceed limit."""

    def counted(batches):
        common.claim("op5")
        count = transducer(model_path).count
        for ids, texts in common.rows(batches):
            n = [count(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return common.doc_texts(docs).mapInArrow(counted, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

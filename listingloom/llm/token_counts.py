"""Token counts by a finite-state transducer compiled from a byte-fallback BPE model.

Reading a text letter by letter, the encoding of each prefix ends in a token that follows from the last tokens of a few
shorter prefixes: the token must be one the model can make, and must not merge with the token before it. What has to be
remembered is the longest suffix that some piece continues, with the last token and the relative count at each place in it
where a piece may still begin. That is a finite set of states; they are made when first met, each transition with the
number of tokens it adds (or takes back, when letters merge), and kept in a table that numpy walks for many text chunks in
step. Texts are cut into chunks, at word starts where there are any. The map of a chunk (state before to state after and
tokens) is constant if it opens with a word start, as no piece holds one after another letter; else it is found for each
state that some chunk before it can end in. The maps are then composed by a parallel prefix scan: in each round every chunk
state takes over the tokens of the one it points to and points twice as far.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from listingloom.llm.held import held, tidied

LIMIT = 4096
CHUNK = 256
SPACE = "▁"
#: Letters with a column of their own (at first, at most), and entries of the table; one that has grown full is begun anew.
COLUMNS, MOST_COLUMNS, ENTRIES = 128, 256, 1 << 25
_BITS, _ZERO = 5, 16
#: After so many rounds, states that are at most so many are tried in all chunks of their texts at once.
EACH_ROUNDS, FEW_STATES = 3, 64
_PAD = 0


class Transducer:
    """Lazily built: step(state, letter) gives the next state and the change of the token count."""

    def __init__(self, scores: dict[str, float], library=None):
        self.scores, self.library = scores, library
        self.prefixes = {p[:i] for p in scores for i in range(1, len(p))}
        self.words_apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in scores)
        self._apart: dict[tuple[str, str], bool] = {}
        self._halves: dict[str, tuple[str, str] | None] = {}
        self.width = COLUMNS
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.table = np.full(1 << 12, -1, np.int32)
        self.letters: list[str | int] = [""]
        self.columns = np.zeros(0x110000, np.uint8)
        self.root = self._number(("", ((0, None, 0),)))

    def _number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            if (found + 1) * self.width > len(self.table):
                self.table = np.concatenate([self.table, np.full(max(len(self.table) // 2, 64 * self.width), -1, np.int32)])
            self.table[found * self.width + _PAD] = (found * self.width) << _BITS | _ZERO
        return found

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one; ("", "") for a letter, None if the merges never lead to it."""
        if piece not in self._halves:
            parts = list(piece)
            while len(parts) > 2:
                best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
                if best is None:
                    break
                i = -best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            made = piece in self.scores and len(parts) <= 2
            self._halves[piece] = (tuple(parts) if len(parts) == 2 else ("", "")) if made else None
        return self._halves[piece]

    def apart(self, a: str, b: str) -> bool:
        """Whether two pieces stay apart when they meet.

        Their merges are undone, the latest first; at no time may the two parts that touch have a merge that is due
        before the one just undone (between equals the leftmost comes first).
        """
        found = self._apart.get((a, b))
        if found is None:
            due, left, right = -float("inf"), a, b
            found = True
            while found:
                across = self.scores.get(left + right)
                if across is not None and across > due:
                    found = False
                    break
                x, y = self.halves(left), self.halves(right)
                if not x[0] and not y[0]:
                    break
                if x[0] and (not y[0] or self.scores[left] < self.scores[right]):
                    due, left = self.scores[left], x[1]
                else:
                    due, right = np.nextafter(self.scores[right], -np.inf), y[0]
            self._apart[a, b] = found
        return found

    def step(self, state: int, letter: str | int) -> tuple[int, int]:
        """letter: a character that is a piece, or the number of bytes of one that isn't."""
        if isinstance(letter, int):
            return self.root, letter
        suffix, places = self.states[state]
        if letter == SPACE and self.words_apart and not suffix.endswith(SPACE):
            suffix, places = self.states[self.root]
        for length, last, count in places:
            piece = suffix[len(suffix) - length :] + letter
            if self.halves(piece) is not None and (last is None or self.apart(last, piece)):
                break
        else:
            raise ValueError(f"no encoding ends in {suffix + letter!r}")
        added = count + 1
        kept = [(n + 1, last, count - added) for n, last, count in places if suffix[len(suffix) - n :] + letter in self.prefixes]
        longest = max((n for n, _, _ in kept), default=0)
        ahead = (suffix + letter)[len(suffix) + 1 - longest :]
        return self._number((ahead, (*kept, (0, piece, 0)))), added

    def column(self, text: str) -> np.ndarray:
        """The columns of a text's letters; new letters get one, and those beyond the table's width none (0)."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.columns[codes]
        if not out.all():
            for code in np.unique(codes[out == 0]).tolist():
                c = chr(code)
                letter = c if c in self.scores else len(c.encode("utf-8", "surrogatepass"))
                if letter in self.letters:
                    self.columns[code] = self.letters.index(letter)
                elif len(self.letters) < self.width:
                    self.columns[code] = len(self.letters)
                    self.letters.append(letter)
            out = self.columns[codes]
        return out

    def walk(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run chunks (flat[first : first + size], the longest in front) from their states: the states after, and the tokens added."""
        total = np.zeros(len(state), np.int64)
        state = state.copy()
        steps = int(size[0]) if len(size) else 0
        running = len(size) - np.searchsorted(size[::-1], np.arange(steps), "right")
        for step, n in enumerate(running.tolist()):
            at = state[:n] + flat[first[:n] + step]
            entry = self.table[at]
            if entry.min() < 0:
                for k in np.unique(at[entry < 0]).tolist():
                    ahead, added = self.step(k // self.width, self.letters[k % self.width])
                    self.table[k] = (ahead * self.width) << _BITS | (added + _ZERO)
                entry = self.table[at]
            state[:n] = entry >> _BITS
            total[:n] += (entry & (2 * _ZERO - 1)) - _ZERO
        return state, total

    def count_slowly(self, text: str) -> int:
        state, total = self.root, 0
        for c in text:
            state, added = self.step(state, c if c in self.scores else len(c.encode("utf-8", "surrogatepass")))
            total += added
        return total

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text: a space is put in front, and an empty text has none.

        A text that the transducer can't take apart is counted by the library.
        """
        try:
            return self._counts(texts)
        except ValueError:
            if len(texts) == 1:
                return np.array([len(self.library.encode(texts[0]))], np.int64)
            return np.concatenate([self.counts([t]) for t in texts])

    def _counts(self, texts: list[str | None]) -> np.ndarray:
        if len(self.letters) == self.width < MOST_COLUMNS:
            self.width *= 2
            self.clear()
        if len(self.states) * self.width > ENTRIES:
            self.clear()
        own, slow = [], {}
        for i, t in enumerate(texts):
            t = SPACE + t.replace(" ", SPACE) if t else ""
            letters = self.column(t)
            if len(letters) and not letters.all():
                slow[i], letters = t, letters[:0]
            own.append(letters)
        sizes = np.array([len(x) for x in own])
        out = self._scan(np.concatenate([*own, np.zeros(0, np.uint8)]).astype(np.int32), sizes)
        for i, t in slow.items():
            out[i] = self.count_slowly(t)
        return out

    def _scan(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of each text; flat: the texts' letters one after another."""
        begin = np.cumsum(sizes) - sizes
        cells = -(-sizes // CHUNK)
        first = np.repeat(begin - (np.cumsum(cells) - cells) * CHUNK, cells) + np.arange(cells.sum()) * CHUNK
        if not len(first):
            return np.zeros(len(sizes), np.int64)
        space = self.columns[ord(SPACE)]
        word = (flat == space) & (np.concatenate([[_PAD], flat[:-1]]) != space) if self.words_apart else np.zeros(len(flat), bool)
        # A cell's chunk begins at its first word start, or where the cell begins if it has none; a text's first chunk with the text.
        starts = np.concatenate([np.flatnonzero(word), [len(flat)]])
        at = starts[np.searchsorted(starts, first)]
        opens = np.zeros(len(first), bool)
        opens[(np.cumsum(cells) - cells)[cells > 0]] = True
        end = np.repeat(begin + sizes, cells)
        apart = at < np.minimum(first + CHUNK, end)
        first = np.where(apart & ~opens, at, first)
        fixed = apart | opens
        size = np.where(np.concatenate([opens[1:], [True]]), end, np.concatenate([first[1:], [0]])) - first
        root = self.root * self.width
        # Each row is a chunk with a state it is entered in; rows are added until every state that a chunk ends in has one behind it.
        chunk, entered = np.arange(len(first)), np.full(len(first), root)
        after, tokens = self._run(flat, first, size, chunk, entered)
        known = (chunk << 32) | entered
        new, text, rounds = chunk, np.repeat(np.arange(len(sizes)), cells), 0
        while len(new):
            ahead = chunk[new] + 1
            wanted = np.unique(((ahead << 32) | after[new])[(ahead < len(first)) & ~fixed[np.minimum(ahead, len(first) - 1)]])
            rounds += 1
            states = np.unique(wanted & 0xFFFFFFFF)
            if rounds > EACH_ROUNDS and 0 < len(states) <= FEW_STATES:  # letters that repeat: few states go round
                rest = np.flatnonzero(np.isin(text, text[wanted >> 32]) & ~fixed)
                wanted = np.unique((rest[:, None] << 32) | states[None, :])
            wanted = wanted[~np.isin(wanted, known)]
            new = len(chunk) + np.arange(len(wanted))
            chunk, entered = np.concatenate([chunk, wanted >> 32]), np.concatenate([entered, wanted & 0xFFFFFFFF])
            ends, added = self._run(flat, first, size, wanted >> 32, wanted & 0xFFFFFFFF)
            after, tokens, known = np.concatenate([after, ends]), np.concatenate([tokens, added]), np.concatenate([known, wanted])
        order = np.argsort(known)
        ahead = chunk + 1
        ends_text = np.concatenate([opens, [True]])[ahead]
        inside = np.minimum(ahead, len(first) - 1)
        to = order[np.searchsorted(known[order], (inside << 32) | np.where(fixed[inside], root, after)) % len(order)]
        to = np.where(ends_text, len(chunk), to)
        total, to = np.append(tokens, 0), np.append(to, len(chunk))
        for _ in range(int(cells.max()).bit_length()):
            total, to = total + total[to], to[to]
        out = np.zeros(len(sizes), np.int64)
        out[cells > 0] = total[np.flatnonzero(opens)]
        return out

    def _run(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray, chunk: np.ndarray, entered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-size[chunk], kind="stable")
        after, tokens = np.zeros(len(chunk), np.int64), np.zeros(len(chunk), np.int64)
        after[order], tokens[order] = self.walk(flat, first[chunk][order], size[chunk][order], entered[order].astype(np.int32))
        return after, tokens


def load(path: str) -> Transducer:
    """The transducer of a sentencepiece BPE model file, kept between tasks."""

    def build() -> Transducer:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return Transducer({model.id_to_piece(i): model.get_score(i) for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}, model)

    return held("token_counts", path, build)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty, with no bytes and no tokens; repeated rows and null ids are counted each. Texts are read
    whole, very long ones in time in proportion to their length. An empty table gives no rows.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = load(path)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found, start, size = [], 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= 1 << 20 or i + 1 == len(texts):
                    found.append(transducer.counts(texts[start : i + 1]))
                    start, size = i + 1, 0
            counts = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    found = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))

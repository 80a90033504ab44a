"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from a model file: the normaliser (runs of blanks and of other
characters to the escaped text, with dummy prefix and squeezed blanks), the lexicon (characters to
the pieces that end there, with the bytes of a character as its fallback) and an acceptor of piece
sequences. A text is composed with them character by character, and the shortest path in the
tropical semiring (least sum of weights) is the encoding.

Unigram models: a piece weighs minus its score and the acceptor takes every sequence.

BPE models: the result of greedy merging is the one sequence in which every two neighbours are
left alone when merged by themselves (merging inside a piece never looks past a boundary that
no merge crosses). So the acceptor's state is the last piece, and an arc has weight 1 where the
two pieces, merged alone, stay as they are, else infinity: one path is left. Arcs are computed
when first met.

Where no piece holds the escaped blank after another character, a text falls apart before each
run of blanks; where none holds both letters and other characters, between these as well (both
are read off the pieces). The paths of words met lately are kept, in bounded number.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import free_name

BLANK = "▁"
RUN = re.compile(" +|[^ ]+")
# States of the normaliser: nothing written yet, after text, after blanks that are written with the next text.
EMPTY, WRITTEN, OPEN = range(3)
WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

# Numbers of model and piece kinds in the model file's format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

# Fixed value: how much less likely than the rarest piece an unknown character is in unigram models.
UNKNOWN_PENALTY = 10.0

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
PATHS_KEPT, ARCS_KEPT, STEPS_KEPT, LONGEST_KEPT = 250_000, 300_000, 200_000, 48
PIECE_ROWS = 64


class PieceModel:
    """Encoder and decoder compiled from the bytes of a model file."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.kind = proto.trainer_spec.model_type
        rules = proto.normalizer_spec
        odd = {p.type for p in proto.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}
        if self.kind not in (UNIGRAM, BPE) or odd or rules.precompiled_charsmap or not rules.escape_whitespaces:
            raise ValueError("only unigram and BPE models of plain pieces with the identity normaliser are compiled")
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that put blanks at the end of words are not compiled")
        self.dummy_prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.lowest = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.pieces = [p.piece for p in proto.pieces]
        self.sizes = [len(piece) for piece in self.pieces]
        letters = "".join(sorted({c for piece in self.ids for c in piece if c.isalpha()}))
        by_letters = re.compile(f"{BLANK}*[{letters}]+|{BLANK}*[^{letters}{BLANK}]+|{BLANK}+") if letters else WORD
        # The finest way to cut a text that cuts no piece.
        self.parts = next((p for p in (by_letters, WORD) if all(len(p.findall(x)) == 1 for x in self.ids)), None)
        self._compile_normaliser()
        self._compile_lexicon()
        self.spelled = [b"" if p.type == CONTROL else p.piece.encode() for p in proto.pieces]
        self.spelled[self.unknown] = " ⁇ ".encode()
        for value, number in self.bytes.items():
            self.spelled[number] = bytes([value])
        # Paths of words met lately, in two generations.
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.arcs: dict[int, float] = {}
        self.histories: dict[int, tuple | None] = {}

    # Lexicon.

    def _compile_lexicon(self) -> None:
        """A state is the longest end of the text that begins a piece; it emits the pieces that end there.

        ``step[state]`` maps a character to the next state, ``short[state]`` is the state of the next
        shorter end, ``emits[state]`` are (length, number, weight) of pieces, longest first.
        """
        self.step: list[dict[str, int]] = [{}]
        own: list[tuple | None] = [None]
        for piece, number in self.ids.items():
            state = 0
            for char in piece:
                after = self.step[state].get(char)
                if after is None:
                    after = self.step[state][char] = len(self.step)
                    self.step.append({})
                    own.append(None)
                state = after
            own[state] = len(piece), number, -self.scores[piece] if self.kind == UNIGRAM else 1.0
        self.short = [0] * len(self.step)
        self.emits: list[tuple] = [()] * len(self.step)
        # Level by level: the shorter ends are known before the longer ones.
        level = [0]
        while level:
            below = []
            for state in level:
                for char, after in self.step[state].items():
                    if state:
                        back = self.short[state]
                        while back and char not in self.step[back]:
                            back = self.short[back]
                        self.short[after] = self.step[back].get(char, 0)
                    longer = (own[after],) if own[after] else ()
                    self.emits[after] = longer + self.emits[self.short[after]]
                    below.append(after)
            level = below
        self.steps_kept = 0

    def advance(self, state: int, char: str) -> int:
        """The next state where ``step`` has none; a bounded number of them is kept for the next time."""
        back = state
        while back and char not in self.step[back]:
            back = self.short[back]
        after = self.step[back].get(char, 0)
        if after and self.steps_kept < STEPS_KEPT:
            self.step[state][char] = after
            self.steps_kept += 1
        return after

    # Normaliser.

    def _compile_normaliser(self) -> None:
        """Arcs of (state, whether the run is of blanks): what is written before the run, what each of its
        characters becomes (None: itself), and the next state."""
        prefix = BLANK if self.dummy_prefix else ""
        self.normaliser = {(EMPTY, False): (prefix, None, WRITTEN), (WRITTEN, False): ("", None, WRITTEN)}
        if self.squeeze:
            self.normaliser[EMPTY, True] = "", "", EMPTY
            self.normaliser[WRITTEN, True] = "", "", OPEN
            self.normaliser[OPEN, False] = BLANK, None, WRITTEN
        else:
            self.normaliser[EMPTY, True] = prefix, BLANK, WRITTEN
            self.normaliser[WRITTEN, True] = "", BLANK, WRITTEN

        # States that both kinds of runs lead back to.
        self.closed = {state for state in (EMPTY, WRITTEN) if all(self.normaliser[state, kind][::2] == ("", state) for kind in (False, True))}

    def normalise(self, text: str) -> str:
        out, state, place = [], EMPTY, 0
        while place < len(text):
            if state in self.closed:
                out.append(text[place:].replace(" ", self.normaliser[state, True][1]))
                break
            run = RUN.match(text, place)[0]
            before, becomes, state = self.normaliser[state, run[0] == " "]
            out += before, run if becomes is None else becomes * len(run)
            place += len(run)
        return "".join(out)

    # Acceptor of piece sequences (BPE).

    def history(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """Scores of the merges that make a piece of its characters, and its first and last part before each
        and after all of them; None if merging ends in something else."""
        parts, scores = list(self.pieces[piece]), self.scores
        made, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            found = [(scores[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in scores]
            if not found:
                return None
            score, place = max(found)
            parts[-place : 2 - place] = [parts[-place] + parts[1 - place]]
            made.append(score)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        made.append(float("-inf"))
        return made, firsts, lasts

    def weigh(self, arc: int) -> float:
        """The weight of an arc, the last piece (-1: the start, -2: an unknown character) << 24 with the next one.

        Both merge by themselves, best score first, until a merge across the boundary is the best one
        left (of equal scores the leftmost comes first): then the arc is closed.
        """
        last, piece = arc >> 24, arc & 0xFFFFFF
        if len(self.arcs) > ARCS_KEPT:
            self.arcs.clear()
        histories = self.histories
        for number in (last, piece):
            if number >= 0 and number not in histories:
                histories[number] = self.history(number)
        right = histories[piece]
        known = right is not None
        if known and last >= 0:
            left, scores = histories[last], self.scores
            ours, _, lasts = left
            theirs, firsts, _ = right
            i = j = 0
            while True:
                across = scores.get(lasts[i] + firsts[j])
                if across is not None and across > ours[i] and across >= theirs[j]:
                    known = False
                    break
                if ours[i] >= theirs[j]:
                    if i + 1 == len(ours):
                        break
                    i += 1
                else:
                    j += 1
        weight = self.arcs[arc] = 1.0 if known else float("inf")
        return weight

    # Composition and shortest path.

    def shortest_path(self, text: str) -> list[int]:
        """Piece numbers of a normalised text, characters without a piece as their bytes."""
        out: list[int] = []
        for start, end, number in self._lightest_path(text):
            if number >= 0:
                out.append(number)
            elif self.bytes:
                out.extend(self.bytes[b] for b in text[start:end].encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _lightest_path(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, number) of the pieces along the path of the least sum of weights, -2 for no piece.

        Of every place are kept the weight of the lightest path to it and its last piece's number. The
        acceptor of a BPE model lets one last piece through at a place, so its state needs no
        room, and the first finite arc is the only one.
        """
        track, endless, sizes = self.kind == BPE, float("inf"), self.sizes
        fallback = 1.0 if track else -self.lowest
        step, emits, arcs = self.step, self.emits, self.arcs
        # Numbers are kept as the left half of an arc.
        weights, lasts = [0.0], [-1 << 24]
        state = 0
        for place, char in enumerate(text, 1):
            try:
                state = step[state][char]
            except KeyError:
                state = self.advance(state, char)
            found = emits[state]
            best, piece = endless, -2
            for length, number, weight in found:
                if track:
                    arc = lasts[place - length] + number
                    weight = arcs[arc] if arc in arcs else self.weigh(arc)
                total = weights[place - length] + weight
                if total < best:
                    best, piece = total, number
                    if track:
                        break
            if not found or found[-1][0] > 1:
                total = weights[-1] + fallback
                if total < best:
                    best, piece = total, -2
            weights.append(best)
            lasts.append(piece << 24)
        path, end = [], len(text)
        while end > 0:
            number = lasts[end] >> 24
            start = end - sizes[number] if number >= 0 else end - 1
            path.append((start, end, number))
            end = start
        return path[::-1]

    def path(self, word: str) -> bytes:
        """The shortest path as 32-bit numbers."""
        found = self.paths.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                found = array("i", self.shortest_path(word)).tobytes()
            if len(word) <= LONGEST_KEPT:
                if len(self.paths) >= PATHS_KEPT:
                    self.older, self.paths = self.paths, {}
                self.paths[word] = found
        return found

    def encode(self, text: str) -> array:
        text = self.normalise(text)
        words = self.parts.findall(text) if self.parts else [text][: len(text)]
        out = array("i")
        out.frombytes(b"".join(map(self.path, words)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of piece numbers; bytes that are no UTF-8 become the replacement character."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def shipped(spark: SparkSession, model_path: str) -> Callable[[], PieceModel]:
    """The model file, read once by the driver and sent to the tasks; compiled, and given up, by each task."""
    with open(model_path, "rb") as file:
        content = spark.sparkContext.broadcast(file.read())

    def compiled() -> PieceModel:
        return PieceModel(content.value)

    return compiled


def encode_texts(docs: DataFrame, model_path: str = MODEL_PATH, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ids, n_ids and round_trip (decoding gives the text back).

    A null or empty text has no ids and counts as given back. Every row stands for itself;
    all other columns are kept, but a column named like one of the new ones is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "ids", "n_ids", "round_trip")]
    compiled, source_name = shipped(docs.sparkSession, model_path), free_name(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = compiled()
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(start, PIECE_ROWS)
                flat, ends, exact = array("i"), [0], []
                for value in piece.column(source_name):
                    own = value.as_py() or ""
                    ids = model.encode(own)
                    exact.append(model.decode(ids) == own)
                    flat.extend(ids)
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
                counts = pa.array([b - a for a, b in zip(ends, ends[1:])], pa.int64())
                columns = [piece.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, lists, counts, pa.array(exact, pa.bool_())], names=[*kept, "ids", "n_ids", "round_trip"])

    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias(source_name))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema.fields)
    return source.mapInArrow(run, f"{types}, ids array<int>, n_ids long, round_trip boolean" if kept else "ids array<int>, n_ids long, round_trip boolean")


def decode_ids(encoded: DataFrame, model_path: str = MODEL_PATH, ids: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the text of its piece numbers; null ids give a null text."""
    kept = [c for c in encoded.columns if c not in (ids, into)]
    compiled, source_name = shipped(encoded.sparkSession, model_path), free_name(encoded, "_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = compiled()
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE_ROWS):
                piece = batch.slice(start, PIECE_ROWS)
                texts = [None if x is None else model.decode(x) for x in piece.column(source_name).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, into])

    source = encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(ids).alias(source_name))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name in kept]
    return source.mapInArrow(run, ", ".join([*fields, f"`{into}` string"]))

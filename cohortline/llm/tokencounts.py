"""Token counts by a finite-state transducer compiled from a sentencepiece BPE model.

The transducer reads characters. Its state is the longest suffix read that begins a piece, and for each suffix of
the text that begins a piece the last token and the number of tokens, relative to now, before that suffix. The last
token of a prefix is the one piece ending there that may follow the last token before it; two tokens may
follow each other if merging their joined characters gives just them. So each transition changes the number of tokens
by a fixed amount, with which it is annotated. States and transitions are compiled when first met, and kept per process.

No piece crosses from another character to a space, so the transducer is back in its initial state at each such place. Texts
are cut into chunks of a fixed number of characters. A chunk's state map is the part before its first such place, the
number of tokens up to its last one, and the part after it: what depends on the state in which the chunk is
entered is only the first part, and the state in which it is left is given by the last. The maps of
a text's chunks compose in order, whatever their number; the seams are counted by the same transducer.

A null or empty text has no tokens. Each input row gives one row, also null and repeated keys. Characters that are no piece
count as their UTF-8 bytes; strings of control symbols inside texts are ordinary characters, as in the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm.text import per_process

SPACE = "▁"
CHUNK = 1 << 16
STATES = 300_000
WORDS = 400_000


class Transducer:
    """Counts of tokens of strings that begin with a space or hold none."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.score = dict(pieces)
        runs = {len(p) for p in self.score if set(p) == {SPACE}}
        crossing = [p for p in self.score if SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and set(p) != {SPACE}]
        letters = {c for p in self.score for c in p}
        others = [s for p, s in pieces if set(p) != {SPACE}]
        low = {s for p, s in pieces if set(p) == {SPACE} and len(p) > 1}
        if crossing or letters - set(self.score) or len(set(others)) != len(others) or \
                len(low) > 1 or low and max(low) >= min(others):
            raise ValueError("this vocabulary needs other rules for spaces, characters or equal scores")
        self.longest_run = max(runs, default=1)
        self.rest = [len(self.merged(SPACE * n)) for n in range(self.longest_run)]
        self._build([p for p in self.score if set(p) != {SPACE} or p == SPACE])
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def _build(self, pieces: list[str]) -> None:
        """Trie with failure links; nodes in ``deeper[(node, character)]``."""
        self.deeper: dict = {}
        self.depth, self.token, self.string = [0], [-1], [""]
        for p in pieces:
            node = 0
            for c in p:
                if (node, c) not in self.deeper:
                    self.deeper[node, c] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                    self.string.append("")
                node = self.deeper[node, c]
            self.token[node] = node
            self.string[node] = p
        self.fail = [0] * len(self.depth)
        for (parent, c), node in sorted(self.deeper.items(), key=lambda x: self.depth[x[1]]):
            if parent:
                self.fail[node] = self._step(self.fail[parent], c)

    def _step(self, node: int, c: str) -> int:
        while (node, c) not in self.deeper:
            if not node:
                return 0
            node = self.fail[node]
        return self.deeper[node, c]

    def reset(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.names: dict[int, tuple] = {}
        self.words: dict[str, int] = {}
        self.start = self._state((0, ((0, -1, 0),)))

    def _state(self, name: tuple) -> dict:
        if name not in self.states:
            self.states[name] = {}
            self.names[id(self.states[name])] = name
        return self.states[name]

    def merged(self, text: str) -> list[str]:
        """Tokens of a short string, merged by score from left to right."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def _fit(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        if (a, b) not in self.fits:
            x, y = self.string[a], self.string[b]
            self.fits[a, b] = self.merged(x + y) == [x, y]
        return self.fits[a, b]

    def _compile(self, state: dict, c: str) -> tuple[dict, int]:
        """The transition of ``state`` on ``c``: the next state and the change in the number of tokens."""
        node, before = self.names[id(state)]
        now = self._step(node, c)
        if not now:  # no piece has this character: its bytes are tokens, and nothing merges over it
            move = (self.start, len(c.encode("utf-8", "surrogatepass")))
        else:
            at = {length: (token, count) for length, token, count in before}
            chain, tail = now, []
            token = count = None
            while chain:
                if token is None and self.token[chain] >= 0:
                    last, so_far = at[self.depth[chain] - 1]
                    if self._fit(last, chain):
                        token, count = chain, so_far + 1
                if (self.depth[chain] - 1) in at:
                    tail.append((self.depth[chain], *at[self.depth[chain] - 1]))
                chain = self.fail[chain]
            name = (now, (*[(n, t, k - count) for n, t, k in tail], (0, token, 0)))
            move = (self._state(name), count)
        state[c] = move
        return move

    def walk(self, text: str) -> int:
        state, total = self.start, 0
        for c in text:
            state, change = state.get(c) or self._compile(state, c)
            total += change
        if len(self.states) > STATES:
            self.reset()
        return total

    def _word(self, word: str) -> int:
        """Tokens of a space and the word."""
        if len(self.words) > WORDS:
            self.words.clear()
        found = self.walk(SPACE + word)
        if len(word) <= 100:
            self.words[word] = found
        return found

    def first_token(self, text: str) -> str:
        """The first token, from the tokens' last ends backwards."""
        ends = []
        state = self.start
        for c in text:
            state, _ = state.get(c) or self._compile(state, c)
            name = self.names[id(state)]
            ends.append(name[1][-1][1])
        at = len(text)
        token = text[0]
        while at > 0:
            node = ends[at - 1]
            token = self.string[node] if node >= 0 else text[at - 1]
            at -= len(token)
        return token

    def spaces(self, n: int) -> int:
        return n // self.longest_run + self.rest[n % self.longest_run]

    def count(self, text: str) -> int:
        """Tokens of a string that begins with a space or is empty."""
        words = text[1:].split(" ") if text else []
        known = self.words
        total = run = 0
        for w in words:
            run += 1
            if w:
                total += known.get(w) or self._word(w)
                if run > 1:  # the last space is merged with the word, or it stands with those before it
                    total += self.spaces(run - 1) if self.first_token(SPACE + w) != SPACE else self.spaces(run) - 1
                run = 0
        return total + self.spaces(run)


def load(path: str) -> Transducer:
    def make():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return Transducer([(model.id_to_piece(i), model.get_score(i)) for i in plain])

    return per_process(f"transducer {path}", make)


def _boundaries(chunk: str) -> tuple[int, int]:
    """The first and last place where a space follows another character; (-1, -1) without one."""
    first = 0
    while True:
        first = chunk.find(" ", first)
        if first < 0:
            return -1, -1
        if first and chunk[first - 1] != " ":
            break
        first += 1
    last = len(chunk)
    while True:
        last = chunk.rfind(" ", 0, last)
        if chunk[last - 1] != " ":
            return first, last


def counted(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``key``, ``n_bytes``, ``n_tokens``.

    An empty table gives no rows; other columns are not read. A long text is cut into chunks of about ``chunk`` characters.
    """

    @F.arrow_udf(T.StructType([T.StructField("head", T.StringType()), T.StructField("inner", T.LongType()), T.StructField("tail", T.StringType())]))
    def mapped(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = load(model)
        for column in chunks:
            heads, inner, tails = [], [], []
            for x in column:
                x = x.as_py().replace(SPACE, " ")
                a, b = _boundaries(x)
                heads.append(x if a < 0 else x[:a])
                inner.append(0 if a < 0 else machine.count(x[a:b]))
                tails.append(None if a < 0 else x[b:])
            yield pa.StructArray.from_arrays([pa.array(heads, pa.string()), pa.array(inner, pa.int64()), pa.array(tails, pa.string())],
                                             names=["head", "inner", "tail"])

    @F.arrow_udf(T.LongType())
    def seamed(seams: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = load(model)
        for column in seams:
            yield pa.array([sum(map(machine.count, x.as_py())) for x in column], pa.int64())

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.octet_length(t).cast("long").alias("n_bytes"),
                       F.when(t == "", "").otherwise(F.concat(F.lit(" "), t)).alias("t")).withColumn("row", F.monotonically_increasing_id())
    pieces = rows.select("row", "key", "n_bytes", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length("t") / chunk) - 1, F.lit(0)).cast("int")),
        lambda i: F.substring(F.col("t"), i * chunk + 1, F.lit(chunk)))).alias("i", "piece"))
    maps = pieces.select("row", "key", "n_bytes", "i", mapped("piece").alias("m"))
    whole = maps.groupBy("row").agg(F.first("key").alias("key"), F.first("n_bytes").alias("n_bytes"), F.sum("m.inner").alias("inner"),
                                    F.array_sort(F.collect_list(F.struct("i", F.col("m.head").alias("head"), F.col("m.tail").alias("tail")))).alias("maps"))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("seams"))
    step = lambda s, m: F.when(m["tail"].isNull(), F.struct(F.concat(s["open"], m["head"]).alias("open"), s["seams"].alias("seams"))).otherwise(
        F.struct(m["tail"].alias("open"), F.concat(s["seams"], F.array(F.concat(s["open"], m["head"]))).alias("seams")))
    seams = F.aggregate("maps", start, step, lambda s: F.concat(s["seams"], F.array(s["open"])))
    return whole.select(F.col("key").alias(key), "n_bytes", (F.col("inner") + seamed(seams)).alias("n_tokens"))

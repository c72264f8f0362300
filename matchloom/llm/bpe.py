"""BPE encoding and decoding by a tokenization automaton, compiled once into flat tables.

The automaton reads tokens: one state for the start and one for each token, reached by that token's arcs.  It is
compiled from the merge list by successive merge gadgets.  The gadget of merge r, (x, y) -> z, looks at the path
x y: if the gadgets so far left it, the path is removed and an arc z takes its place, so z gets the left ends of
x and the right ends of y, each with the merge that used it up.  A pair of neighbouring tokens (u, v) therefore
has an arc exactly if no gadget (x, y) met a right end x of u and a left end y of v while both stood; of equal
merges the left one goes first.  What the automaton accepts are the correct tokenizations, each prefix of one is
one, and a string has exactly one, so a word has a single state at each position.

Tables.  *Arcs*: tokens are numbered in preorder of the tree in which a token hangs below its left part, ordered by
merge, so one gadget takes a token and a run of numbers from a state.  A row lists the ranges of numbers that its
state has no arc to; all others are the default arc.  *Labels*: the bytes of all tokens form a double array (the
last byte of a word is a symbol of its own).  Encoding is look-ups only: the labels that begin at each position,
then, by ascending position, the one of them that an arc reaches; that state is final, nothing is taken back, and
the work is linear in the word.  Words of a batch advance together; very long words alone.

Texts are normalised and pre-split as the tokenizer file says (NFC, lower case letter by letter, words, single
digits, runs of other marks), and special tokens in a text stay whole.  Decoding emits the labels of the arcs
joined by a space, as the file names no decoder.

Defined results: NULL and empty texts have no tokens and decode to the empty text; texts of any length are encoded
whole; repeated rows keep a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import give_back, tidy

NEVER, LAST, LONG = 1 << 60, 256, 512
ROW = np.int64(1 << 20)  # more than the tokens of any file
#: The words of the tokenizer file, with white space as Unicode has it, in the syntax of Arrow's expressions.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\x0b\x85\p{Z}\p{L}\p{N}]+"
#: Texts that go through the Python splitter: those with special tokens, with controls that Arrow calls space, with
#: the one letter whose lower case is two, or with anything outside blocks that are composed (NFC) as they stand.
HARD = r"<\||[\x1c-\x1f\x{130}]|[^\x00-\x{2ff}\x{400}-\x{482}\x{48a}-\x{52f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}\x{3041}-\x{3094}\x{30a1}-\x{30fa}\x{4e00}-\x{9fff}\x{ac00}-\x{d7a3}]"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_marks() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 itself, others from U+0100 up."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    more = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(more)) for b in range(256)]


class Gadgets:
    """The ends of every token that the successive merge gadgets leave; only compiling needs them."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.rank: dict[tuple[int, int], int] = {}
        #: token -> its right and left ends: (token, the merge that used it up)
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        #: left part -> (merge, token) of the tokens made from it; left token -> (merge, right token)
        self.made: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.base: list[int] = []
        for mark in byte_marks():
            for symbol in (mark, mark + end):
                if symbol in vocab:
                    self.base.append(vocab[symbol])
                    self._state(vocab[symbol], [], [])
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            alive = z not in self.right and x in self.right and y in self.right and self._meets(x, y)
            self.rank.setdefault((x, y), r)
            if alive:
                self._state(z, [(t, min(until, r)) for t, until in self.right[y]], [(t, min(until, r)) for t, until in self.left[x]])
                self.made[x].append((r, z))

    def _state(self, token: int, right: list[tuple[int, int]], left: list[tuple[int, int]]) -> None:
        self.right[token] = [(token, NEVER), *right]
        self.left[token] = [(token, NEVER), *left]

    def _meets(self, u: int, v: int) -> bool:
        """No gadget so far removes the path u v."""
        for x, used in self.right[u]:
            for y, until in self.left[v]:
                r = self.rank.get((x, y))
                if r is not None and r < used and r <= until:
                    return False
        return True


class Automaton:
    """Flat tables (a few megabytes), compiled once and shipped to the tasks."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.label = {i: t for t, i in vocab.items()}
        gadgets = Gadgets(vocab, merges, end)
        self._arcs(gadgets, {i for i, t in self.label.items() if not t.endswith(end)})
        byte = {m: b for b, m in enumerate(byte_marks())}
        words = {}
        for t in gadgets.right:
            marks = self.label[t]
            final = marks.endswith(end) and len(marks) > len(end)
            symbols = [byte[c] for c in (marks[: -len(end)] if final else marks)]
            symbols[-1] += LAST * final
            words[tuple(symbols)] = t
        self._labels(words)

    def __getstate__(self) -> dict:
        """Tasks need the tables alone."""
        return {k: v for k, v in self.__dict__.items() if k != "label"}

    def _arcs(self, gadgets: Gadgets, inner: set[int]) -> None:
        """Rows of missing arcs.  ``first[i], behind[i]`` are ``state * ROW + number`` of the i-th missing range."""
        number, stop = {}, {}
        for root in gadgets.base:
            todo = [(root, False)]
            while todo:
                t, done = todo.pop()
                if done:
                    stop[t] = len(number)
                    continue
                number[t] = len(number)
                todo.append((t, True))
                todo += [(z, False) for _, z in reversed(gadgets.made.get(t, ()))]
        taken = defaultdict(list)  # left token -> (merge, ranges of tokens that lose their arc)
        for (x, y), r in gadgets.rank.items():
            if x in number and y in number:
                below = gadgets.made.get(y, ())
                k = bisect_left(below, (r, -1))
                begin = number[below[k][1]] if k < len(below) else stop[y]
                taken[x].append((r, number[y], number[y] + 1, begin, stop[y]))
        table = {x: np.array(sorted(rows), np.int64) for x, rows in taken.items()}
        first, behind = [np.array([-1], np.int64)], [np.array([-1], np.int64)]
        for u in sorted(inner & set(number)):
            for x, used in gadgets.right[u]:
                if x in table:
                    rows = table[x][: np.searchsorted(table[x][:, 0], used)]
                    first += [u * ROW + rows[:, 1], u * ROW + rows[:, 3]]
                    behind += [u * ROW + rows[:, 2], u * ROW + rows[:, 4]]
        begin, end = np.concatenate(first), np.concatenate(behind)
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        fresh = np.concatenate([[True], begin[1:] > end[:-1]])
        self.first = begin[fresh]
        self.behind = end[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(end) - 1]])]
        self.number = np.zeros(max(self.label) + 1, np.int64)
        self.number[list(number)] = list(number.values())

    def _labels(self, words: dict[tuple[int, ...], int]) -> None:
        """Double array of the labels: the child of node n by symbol s is ``base[n] + s`` if ``above`` of that is n."""
        root: dict = {}
        for symbols, t in words.items():
            node = root
            for s in symbols:
                node = node.setdefault(s, {})
            node[None] = t
        self.longest = max(map(len, words))
        size = 4 * sum(map(len, words)) + 8 * LAST
        free = np.ones(size, bool)
        free[0] = False
        base, above, token = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        low, levels = 1, [(0, root)]
        while levels:  # level by level, wide nodes first, so that narrow ones fill the gaps
            levels.sort(key=lambda x: -len(x[1]))
            below = []
            for n, node in levels:
                if None in node:
                    token[n] = node[None]
                symbols = np.array([s for s in node if s is not None], np.int64)
                if not len(symbols):
                    continue
                if not free[low]:
                    low += int(np.argmax(free[low:]))
                start, step = low, 64
                while True:
                    slots = np.flatnonzero(free[start : start + step]) + start - symbols[0]
                    slots = slots[slots >= 0]
                    fits = slots[free[slots[:, None] + symbols].all(axis=1)] if len(slots) else slots
                    if len(fits):
                        break
                    start, step = start + step, 2 * step
                base[n] = b = int(fits[0])
                for s, child in node.items():
                    if s is not None:
                        free[b + s], above[b + s] = False, n
                        below.append((b + s, child))
            levels = below
        n = int(np.flatnonzero(~free)[-1]) + 2 * LAST + 1
        self.base, self.above, self.token = base[:n], above[:n], token[:n]

    def missing(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether the states ``u`` have no arc to the tokens ``v``."""
        key = u * ROW + self.number[v]
        return self.behind[np.searchsorted(self.first, key, "right") - 1] > key

    def _found(self, symbols: np.ndarray, limit: np.ndarray, begin: int, behind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, behind, token) of all labels that begin in [begin, behind); ``limit`` is the end of each position's word."""
        out = []
        at, node, depth = np.arange(begin, behind), np.zeros(behind - begin, np.int32), 0
        while len(at):
            down = self.base[node] + symbols[at + depth]
            ok = self.above[down] == node
            at, node, depth = at[ok], down[ok], depth + 1
            t = self.token[node]
            hit = np.flatnonzero(t >= 0)
            out.append((at[hit], at[hit] + depth, t[hit]))
            more = np.flatnonzero(at + depth < limit[at])
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens, all tokens) of pre-split words, none of them empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        if len(size) and size.max() > LONG:
            count, parts = np.zeros(len(words), np.int64), []
            for k in np.split(np.arange(len(words)), np.unique([x for i in np.flatnonzero(size > LONG) for x in (i, i + 1)])):
                if len(k) == 1 and size[k[0]] > LONG:
                    parts.append(self.long_word(words[k[0]]))
                    count[k] = len(parts[-1])
                elif len(k):
                    count[k], tokens = self.words([words[i] for i in k])
                    parts.append(tokens)
            return count, np.concatenate(parts)
        if not len(size):
            return size, np.zeros(0, np.int32)
        stops = np.cumsum(size)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        symbols[stops - 1] += LAST
        begins = np.repeat(stops - size, size)
        first, behind, token = self._found(symbols, np.repeat(stops, size), 0, len(symbols))
        order = np.lexsort((behind, behind - begins[first]))
        first, behind, token = first[order], behind[order], token[order]
        alone = np.ones(len(behind), bool)  # the only label that ends here: every position has one
        same = behind[1:] == behind[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        state, back = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int64)
        steps = np.searchsorted((behind - begins[first]), np.arange(1, int(size.max()) + 2))
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            f, e, t = first[a:b], behind[a:b] - 1, token[a:b]
            sure = alone[a:b] | (f == begins[f])
            ask = np.flatnonzero(~alone[a:b] & (f > begins[f]))
            sure[ask] = ~self.missing(state[f[ask] - 1].astype(np.int64), t[ask])
            # A label of the whole front is a state only if no shorter one ends here.
            state[e[sure]], back[e[sure]] = t[sure], f[sure]
        return self._collect(state, back, stops, begins, size)

    def _collect(self, state, back, stops, begins, size):
        ends = np.zeros(len(state), bool)
        at = stops - 1
        while len(at):
            ends[at] = True
            before = back[at] - 1
            at = before[back[at] > begins[at]]
        return np.add.reduceat(ends.astype(np.int64), stops - size), state[ends]

    def long_word(self, word: bytes, window: int = 1 << 16) -> np.ndarray:
        """One word position by position, ``window`` symbols of labels at a time."""
        n = len(word)
        symbols = np.frombuffer(word, np.uint8).astype(np.int32)
        symbols[-1] += LAST
        state, back = np.zeros(n, np.int32), np.zeros(n, np.int32)
        waiting = [np.zeros(0, np.int64)] * 3
        states: dict[int, int] = {-1: -1}
        firsts, behinds, number = (array("q", x.astype(np.int64).tobytes()) for x in (self.first, self.behind, self.number))
        for begin in range(0, n, window):
            stop = min(n, begin + window)
            found = [np.concatenate(x) for x in zip(waiting, self._found(symbols, np.broadcast_to(np.int64(n), (n,)), begin, stop))]
            now = found[1] <= stop
            waiting = [x[~now] for x in found]
            order = np.lexsort((found[0][now], found[1][now]))
            for f, e, t in zip(*(x[now][order].tolist() for x in found)):
                u = states[f - 1]
                key = (u << 20) + number[t]
                if u < 0 or behinds[bisect_right(firsts, key) - 1] <= key:
                    states[e - 1] = t
                    state[e - 1], back[e - 1] = t, f
            for p in [p for p in states if 0 <= p < stop - self.longest]:
                del states[p]
        out, at = [], n
        while at:
            out.append(int(state[at - 1]))
            at = int(back[at - 1])
        return np.array(out[::-1], np.int32)


class Splitter:
    """Normalises and pre-splits texts as the file says: NFC, lower case, words, single digits, other marks.

    ``split`` gives the words of a text; a special token is a word of its own, which no other word can equal.
    """

    def __init__(self, spec: dict):
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or pattern != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            raise ValueError("only files with NFC, white space, lower case, these words and byte marks")
        self.words = regex.compile(pattern)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(sorted(map(regex.escape, self.special), key=len, reverse=True)) + ")")

    def split(self, text: str) -> list[str]:
        if "<|" in text and self.special:
            return [w for part in self.at_special.split(text) for w in ([part] if part in self.special else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        return self.words.findall("".join(c.lower() for c in text) if "\u03a3" in text else text.lower())


def cuts(text: str, most: int) -> Iterator[str]:
    """A text in parts of about ``most`` characters, cut in white space, which no word holds."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(c, at + 1, at + most) for c in " \n\t")
        if cut < 0:  # one word of more than a part
            cut = min((x for x in (text.find(c, at + most) for c in " \n\t") if x >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def runs(texts: pa.StringArray, most: int) -> Iterator[tuple[int, int]]:
    """Texts from ``k`` to before ``j`` of some ``most`` bytes in all; a longer one is alone."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, k = np.concatenate([[0], np.cumsum(size)]), 0
    while k < len(texts):
        j = max(k + 1, int(np.searchsorted(total, total[k] + most, "right")) - 1)
        yield k, j
        k = j


class Tokenizer:
    """The compiled tables with the splitter; compiled on the driver, shipped to tasks."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"]:
            raise ValueError("only BPE files without a decoder")
        self.splitter = Splitter(spec)
        self.automaton = Automaton(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        names = self.automaton.label | {i: t for t, i in self.splitter.special.items()}
        every = range(max(names) + 1)
        self.labels = pa.array([names.get(i) for i in every], pa.string())
        self.numbers = pa.array(list(map(str, every)), pa.string())

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, all ids) of normalised words."""
        special = self.splitter.special
        at = [i for i, w in enumerate(words) if w in special]
        size, found = self.automaton.words([w.encode() for w in words if w not in special])
        if at:
            places = np.array(at) - np.arange(len(at))
            found = np.insert(found, np.concatenate([[0], np.cumsum(size)])[places], [special[words[i]] for i in at])
            size = np.insert(size, places, 1)
        return size, found


class Words(dict):
    """Word -> place of its ids; ``encode`` gives the ids of texts.

    ``of`` gives (number of ids, all ids) of new words; ``most`` bounds the words held.
    """

    def __init__(self, splitter: Splitter, of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        super().__init__()
        self.splitter, self.of, self.most = splitter, of, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self[""] = 0
        self.new: list[str] = []
        self.start, self.size, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        place = self[word] = len(self)
        return place

    def learn(self, step: int = 20_000) -> None:
        """Encodes the words that were looked up for the first time."""
        starts, sizes, ids, n = [self.start], [self.size], [self.ids], len(self.ids)
        for k in range(0, len(self.new), step):
            size, found = self.of(self.new[k : k + step])
            sizes.append(size)
            starts.append(n + np.cumsum(size) - size)
            ids.append(found)
            n += len(found)
        self.new.clear()
        self.start, self.size, self.ids = np.concatenate(starts), np.concatenate(sizes), np.concatenate(ids)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and the end of each text in them.

        Words come from Arrow's kernels, as codes into the distinct words of these texts; only those are looked up.
        """
        if len(self) > self.most:
            self.reset()
        texts = pc.fill_null(texts, "")
        hard = pc.match_substring_regex(texts, HARD)
        split = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.if_else(hard, "", texts)), WORDS, r" \0"))
        coded = split.flatten().dictionary_encode()
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        place = np.fromiter(map(self.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        rows = place[coded.indices.to_numpy(zero_copy_only=False)]
        at = np.flatnonzero(hard.to_numpy(zero_copy_only=False))
        if len(at):
            more = [np.fromiter(map(self.__getitem__, self.splitter.split(x)), np.int64) for x in texts.take(pa.array(at)).to_pylist()]
            rows = np.insert(rows, np.repeat(offsets[at + 1], list(map(len, more))), np.concatenate(more))
            offsets[1:] += np.cumsum(np.bincount(at, list(map(len, more)), len(texts))).astype(np.int64)
        if self.new:
            self.learn()
        size = self.size[rows]
        ends = np.concatenate([[0], np.cumsum(size)])
        gathered = self.ids[np.repeat(self.start[rows] - ends[:-1], size) + np.arange(int(ends[-1]))]
        return gathered, ends[offsets[1:]]

    def parts(self, texts: pa.StringArray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(ids, end of each text in them, whether the last text goes on): whole texts, or parts of a very long one."""
        for k, j in runs(texts, most):
            if j == k + 1 and texts[k].is_valid and len(texts[k].as_buffer()) > most:
                found = list(cuts(texts[k].as_py(), most))
                for i, x in enumerate(found):
                    yield *self.encode(pa.array([x], pa.string())), i + 1 < len(found)
            else:
                yield *self.encode(texts.slice(k, j - k)), False


class Encoder:
    """Ids and digests of texts by the compiled tables."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.words = tokenizer, Words(tokenizer.splitter, tokenizer.ids)

    def joined(self, names: pa.StringArray, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The names of each text's ids, joined by spaces."""
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), names.take(pa.array(ids)))
        return pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()

    def digests(self, texts: pa.StringArray, most: int = 1 << 21) -> Iterator[tuple[int, str, str, list[np.ndarray]]]:
        """For each text: number of tokens, SHA-256 of the ids and of the decoded text, and the ids."""
        n, kept, sums = 0, [], [hashlib.sha256(), hashlib.sha256()]
        for ids, ends, goes_on in self.words.parts(texts, most):
            numbers, labels = (self.joined(x, ids, ends) for x in (self.tokenizer.numbers, self.tokenizer.labels))
            begins = np.concatenate([[0], ends[:-1]])
            for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist())):
                for h, x in zip(sums, (numbers[i], labels[i])):
                    if a < b:
                        h.update(b" " + x if n else x)
                n += b - a
                kept.append(ids[a:b])
                if not goes_on:
                    yield n, sums[0].hexdigest(), sums[1].hexdigest(), kept
                    n, kept, sums = 0, [], [hashlib.sha256(), hashlib.sha256()]


_COMPILED: dict[str, Tokenizer] = {}
_HELD: dict[str, Encoder] = {}


def tokenizer(path: str) -> Tokenizer:
    """Compiled once in a process; drivers ship it to the tasks."""
    if path not in _COMPILED:
        _COMPILED[path] = Tokenizer(path)
    return _COMPILED[path]


def encoder(of: Tokenizer) -> Encoder:
    """One for each process; what it has learnt serves later tasks."""
    if of.path not in _HELD:
        _HELD[of.path] = Encoder(of)
    return _HELD[of.path]


def _rows(docs: DataFrame, path: str | None, names: list[str], ids: bool, most: int, slice_rows: int, slice_bytes: int):
    """Texts go through in slices of some rows and bytes, with ``most`` words held: memory, not results, depends on these."""
    compiled = tokenizer(path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(compiled)
        held.words.most = most
        for whole in batches:
            for k in range(0, whole.num_rows, slice_rows):
                b = whole.slice(k, slice_rows)
                gc.disable()  # the cache holds no cycles, and scanning it again and again costs a fifth of the time
                found = list(held.digests(b.column("text"), slice_bytes))
                gc.enable()
                counts = pa.array([r[0] for r in found], pa.int64())
                columns = [b.column("doc_id"), counts]
                if ids:
                    flat = np.concatenate([np.zeros(0, np.int32), *(x for r in found for x in r[3])])
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts.to_numpy())]).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in found], pa.string()) for i in (1, 2))], names)
            give_back()

    kinds = {"ids": "array<int>", "doc_id": "bigint", "n_tokens": "bigint"}
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tidy(run), ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    return _rows(docs, path, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], False, 400_000, 2000, 1 << 21)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the tokens of every whole text and the digests."""
    # Small slices and few words: earlier stages of a pipeline leave executors little memory.
    return _rows(docs, path, ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"], True, 100_000, 500, 1 << 19)


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text): the text that each list of ids decodes to; a NULL list decodes to the empty text."""
    labels = tokenizer(path or default_path()).labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = labels.to_pylist()
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([" ".join(names[i] for i in x or []) for x in part.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id bigint, text string")

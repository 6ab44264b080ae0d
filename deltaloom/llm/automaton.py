"""[op 9] A deterministic automaton over the tokens of a byte pair encoding.

Merges are compiled in the order of their rank. Before the first, one state
accepts any sequence of base symbols. The gadget of merge ``(u, v)`` takes the
state ``s`` that arcs labelled ``u`` lead to, redirects them to a copy of
``s`` without its ``v`` arc, and gives every state that still has the ``u``
arc an arc ``uv`` to where ``v`` led. What remains accepts exactly the token
sequences that the merges can leave behind, one for each word.

A state is held as the state it copies and the one arc that it lost, an arc
as the one it was set beside and when. Nothing else of the merges is kept:
encoding walks from state 0, and a transition not yet in the bounded table is
worked out from that chain of copies.
"""

from __future__ import annotations

import functools
import json
import re

from tokenizers import Tokenizer

#: Entries of a worker's tables (transitions; words), which are emptied when full.
TABLE, WORDS = 400_000, 250_000

#: Characters whose normal form, case and class are the same for re and for the tokenizers library.
PLAIN = re.compile(r"[\x01-\x1b\x20-\x84\x86-\x9f\xa1-\xff]*")
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if visible, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """The automaton of one vocabulary and its merges.

    ``suffix`` marks the last symbol of a word (empty if the vocabulary has
    none). Tokens that no merge can leave behind have no arc anywhere. Raises
    ValueError if two merges make the same token, since paths are then not
    unique.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.labels = {i: s for s, i in vocab.items()}
        bare = lambda s: s[: -len(suffix)] if suffix and s.endswith(suffix) and len(s) > len(suffix) else s
        #: The state that arcs with a label lead to; labels without one have no arcs.
        self.target = {t: 0 for s, t in vocab.items() if len(bare(s)) == 1}
        #: Of each state: the copied state, the arc that the copy lacks, the label whose arcs lead to it. State 0 loops on all symbols.
        self.parent, self.lost, self.label = [-1], [-1], [-1]
        #: Of each made label: the label whose arcs it was set beside, and the first state that was not there then.
        self.beside: dict[int, int] = {}
        self.since: dict[int, int] = {}
        #: Of each label: the arcs lost along its chain of copies, with the copies; where that chain begins.
        self.losses: dict[int, dict[int, int]] = {}
        self.root: dict[int, int] = {}
        self.table: dict[int, int] = {}
        made: set[int] = set()
        for a, b in merges:
            uv = vocab[a + b] if not suffix or not a.endswith(suffix) else -1
            if uv in made or uv in self.target or uv < 0:
                raise ValueError("two merges make one token; its automaton would not be deterministic")
            made.add(uv)
            self._gadget(vocab[a], vocab[b], uv)
        self.table.clear()
        live = {s: t for s, t in vocab.items() if t in self.target}
        self.inner = {s: t for s, t in live.items() if bare(s) is s or not suffix}
        self.final = {bare(s): t for s, t in live.items() if bare(s) is not s} if suffix else self.inner
        self.longest: dict[str, int] = {}  # of the labels that begin so, by up to 4 symbols
        for s in [*self.inner, *self.final]:
            for k in range(1, min(4, len(s)) + 1):
                self.longest[s[:k]] = max(self.longest.get(s[:k], k), min(len(s), 3) if k < 4 else len(s))

    def _gadget(self, u: int, v: int, uv: int) -> None:
        """Redirect the arcs u to a copy of their state without its arc v, and set arcs uv beside them."""
        if u not in self.target or v not in self.target or not self._arc(self.target[u], v):
            return  # no path has v after u: the merge cannot apply, nor can one of its token
        new, old = len(self.parent), self.target[u]
        self.parent.append(old)
        self.lost.append(v)
        self.label.append(u)
        self.target[uv], self.target[u] = self.target[v], new
        self.root.setdefault(u, old)
        self.losses.setdefault(u, {})[v] = new
        self.beside[uv], self.since[uv] = u, new + 1

    def _arc(self, state: int, t: int) -> bool:
        """Whether a state has an arc t, by its chain of copies back to state 0.

        A copy made after arc t has it unless that is the arc it lost; a state
        that was there before has it where it has the arc that t was set
        beside. Copies of one label are passed at once by their losses.
        """
        beside, since, label, losses, root = self.beside, self.since, self.label, self.losses, self.root
        while state:
            own = label[state]
            lost, x, top = losses[own], t, state
            while True:
                copy = lost.get(x)
                if copy is not None and copy <= top:
                    return False
                if (y := beside.get(x)) is None:
                    break
                if since[x] <= top:
                    top = since[x] - 1
                x = y
            state = root[own]
        return True

    def step(self, state: int, t: int) -> int:
        """The state that arc t leads to, or -1; transitions once worked out stay in the table."""
        key = state << 20 | t
        if (to := self.table.get(key)) is None:
            if len(self.table) >= TABLE:
                self.table.clear()
            to = self.table[key] = self.target[t] if self._arc(state, t) else -1
        return to

    def _reach(self, word: str, at: int) -> int:
        """A bound for the length of the longest label that the rest of a word begins with."""
        get = self.longest.get
        return get(word[at : at + 4]) or get(word[at : at + 3]) or get(word[at : at + 2]) or 1

    def encode(self, word: str) -> list[int]:
        """The labels of the only path from state 0 over a word's symbols: longest arcs are tried first, and no position is left twice."""
        n = len(word)
        if not n:
            return []
        inner, final, reach, step, known = self.inner.get, self.final.get, self._reach, self.step, self.table.get
        path: list[int] = []
        states, starts, dead = [0], [0], set()
        nexts = [min(n, reach(word, 0))]
        while True:
            at, size, state = starts[-1], nexts[-1], states[-1]
            to = -1
            while size > 0:
                end = at + size
                t = final(word[at:]) if end == n else inner(word[at:end])
                if t is not None and end not in dead:
                    if (to := known(state << 20 | t)) is None:
                        to = step(state, t)
                    if to >= 0:
                        break
                size -= 1
            if to >= 0:
                nexts[-1] = size - 1
                path.append(t)
                if end == n:
                    return path
                states.append(to)
                starts.append(end)
                nexts.append(min(n - end, reach(word, end)))
            else:
                if not path:
                    raise ValueError("a symbol is not in the vocabulary")
                dead.add(at)
                path.pop()
                states.pop()
                starts.pop()
                nexts.pop()

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs along a path, joined."""
        return "".join(map(self.labels.__getitem__, ids))


class WordTable(dict):
    """Words already encoded; a missing one walks the automaton. When full it starts anew, and words of the table before come over as they are met."""

    def __init__(self, encode, size: int = WORDS) -> None:
        super().__init__()
        self.encode, self.size, self.before = encode, size, {}

    def __missing__(self, word: str):
        if len(self) >= self.size:
            self.before = dict(self)
            self.clear()
        out = self.before.get(word)
        if out is None:
            out = self.encode(word)
        self[word] = out
        return out


class Encoder:
    """A byte-level tokenizer file with its normalizer and pre-splitting, encoded by the automaton."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, self.suffix)
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.letters = dict(enumerate(byte_letters()))
        split, normal = json.dumps(spec["pre_tokenizer"]), spec["normalizer"]
        contractions = "'s|'t|'re|'ve|'m|'ll|'d"
        if "Split" in split:  # words of one class, spaces dropped; lower case
            self.lower, self.pieces = True, re.compile(rf"{contractions}|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
        else:
            self.lower, self.pieces = bool(normal), re.compile(rf"{contractions}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")

    def split(self, text: str) -> list[str]:
        """Pre-split words of a text without special strings, as plain text if it is all plain, else as the library's byte letters."""
        if PLAIN.fullmatch(text):
            return self.pieces.findall(text.lower() if self.lower else text)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return ["\0" + p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def spans(self, text: str) -> list[tuple[str, int]]:
        """The same with each word's end in the text; only for encoders that change no character."""
        if PLAIN.fullmatch(text):
            return [(m.group(), m.end()) for m in self.pieces.finditer(text)]
        return [("\0" + p, e) for p, (_, e) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def word(self, word: str) -> list[int]:
        """Token ids of a pre-split word; one with a leading NUL is in byte letters already."""
        if word[0] == "\0" and len(word) > 1:
            return self.automaton.encode(word[1:])
        return self.automaton.encode("".join(map(self.letters.__getitem__, word.encode())))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file in each worker process."""
    return Encoder(path)

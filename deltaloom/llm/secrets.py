"""[op 10] Secret scans: base patterns, and novelty under a primed zstandard dictionary.

A candidate is a long run of key characters soon after a sensitive word. Its
novelty is what it adds to the compressed size of the text around it, with a
dictionary of identifiers, code idioms and that text primed: prose, paths and
names compress away, random strings do not. A candidate is reported as a
``novel`` span if it costs at least ``NOVELTY`` bytes a character.

What makes a candidate, and what its surroundings are, is part of the method:
it starts at most NEAR characters after a sensitive word, has 16 characters or
more, and is measured against AROUND characters on either side. It has
letters and digits, or both cases within a word, or a run of one class that is
longer than plain words are (``_LONG``); other words are not measured.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import zstandard
from pyspark.sql import DataFrame

from deltaloom.llm.frames import annotate

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN, FIRST, LEAST = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}"), re.compile(r"[A-Za-z0-9]"), 16
SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credential|bearer|authorization|signature", re.IGNORECASE | re.ASCII)
#: Parts of a candidate whose copies count as its own; upper case after lower case or the reverse, past a word's first letter; a run of one class, longer than plain words are (24 letters, 16 digits).
_PART, _CASES, _LONG = re.compile(r"[A-Za-z0-9+]{16,}"), re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]"), re.compile(r"[a-z]{24}|[A-Z]{24}|[0-9]{16}")
HINTS = ("passw", "passp", "secret", "token", "key", "credential", "bearer", "authorization", "signature")
#: Characters before a candidate in which a sensitive word must stand; text around it that is primed; bytes a character.
NEAR, AROUND, NOVELTY = 64, 512, 0.75

_HEXMAP = bytes(49 if 48 <= c <= 57 or 97 <= c <= 102 else 48 for c in range(256))


def identifier_dictionary() -> bytes:
    """Identifiers and idioms of code, combined by rule from short lists."""
    verbs = "get set load read write open close find make build parse format check update delete create insert select append remove".split()
    nouns = "user name file path value index count size list item key config option request response message table column session client server".split()
    idioms = 'import from return self.this.const let var function def class public static void string int float bool true false null none if else for while try except raise throw new'.split()
    styles = (lambda v, n: f"{v}_{n}", lambda v, n: v + n.capitalize(), lambda v, n: f"{v}-{n}", lambda v, n: f"{n}.{v}()")
    names = [f(v, n) for v, n in itertools.product(verbs, nouns) for f in styles]
    runs = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789012345678901234567890123456789", "https://www.example.com/", "-" * 40, "=" * 40, "." * 40, "_" * 40, "x" * 40, "X" * 40, "0" * 40]
    return " ".join([*names, *idioms, *runs]).encode()


class Scanner:
    """Finds secrets in texts."""

    def __init__(self, novelty: float = NOVELTY, dictionary: bytes | None = None) -> None:
        self.novelty, self.dictionary = novelty, identifier_dictionary() if dictionary is None else dictionary
        self.primed = 0

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of base spans; kinds by their place in KINDS."""
        out, low = [], text.lower()
        if any(h in low for h in ("passw", "secret", "token", "api")):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        if b"1" * 24 in text.encode().translate(_HEXMAP):
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return out

    def marginal(self, text: str, start: int, end: int) -> float:
        """Bytes a character that a span adds to the frame of what stands around it. Its own copies there are blanked: a key is no less new for standing twice."""
        run, wide = text[start:end], AROUND + end - start  # so wide that no copy is cut in two
        own = set(_PART.findall(run))
        blank = lambda x: _PART.sub(lambda m: " " if m[0] in own else m[0], x.replace(run, " "))
        left, right = blank(text[max(0, start - wide) : start]), blank(text[end : end + wide])
        before, span, after = left[-AROUND:].encode(), run.encode(), right[:AROUND].encode()
        primer = zstandard.ZstdCompressionDict(self.dictionary + before + after, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)
        lead = before[-64:]
        return (len(packer.compress(lead + span)) - len(packer.compress(lead))) / len(span)

    def novel(self, text: str) -> list[tuple[int, int, int]]:
        """(start, 3, end) of candidates that are new enough. Sensitive words and runs of key characters are each passed once."""
        low, out = text.lower(), []
        if not any(h in low for h in HINTS):
            return out
        runs = [m.span() for m in RUN.finditer(text)]
        at = k = 0
        for stop in (m.end() for m in SENSITIVE.finditer(text)) if runs else ():
            while k < len(runs) and runs[k][1] - max(stop, at, runs[k][0]) < LEAST:
                k += 1
            for j in range(k, len(runs)):
                begin, end = runs[j]
                if begin > stop + NEAR:
                    break
                first = FIRST.search(text, max(stop, at, begin), min(end, stop + NEAR + 1))
                if first and end - first.start() >= LEAST:
                    start, at = first.start(), end
                    if self._mixed(text[start:end]) and self.marginal(text, start, end) >= self.novelty:
                        out.append((start, 3, end))
        return out

    @staticmethod
    def _mixed(run: str) -> bool:
        """Letters with digits, both cases within a word, or a long run of one class: a plain word is no key."""
        return any(c.isdigit() for c in run) and any(c.isalpha() for c in run) or bool(_CASES.search(run) or _LONG.search(run))

    def scan(self, text: str | None) -> dict:
        base = sorted(self.base(text)) if text else []
        spans = sorted([*base, *(self.novel(text) if text else [])])
        join = lambda x: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x)
        n = [sum(k == i for _, k, _ in base) for i in range(3)]
        return {"n_assign": n[0], "n_access": n[1], "n_hex": n[2], "base_sha256": hashlib.sha256(join(base).encode()).hexdigest(), "spans": join(spans)}

    def redact(self, text: str | None, mark: str = "[secret]") -> str | None:
        """The text with every span, overlapping ones as one, replaced by a mark."""
        if not text:
            return text
        out, at = [], 0
        for start, _, end in sorted([*self.base(text), *self.novel(text)]):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join(out) + text[at:]


FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None, novelty: float = NOVELTY) -> DataFrame:
    """Add the columns of FIELDS to every row: counts of base spans, their digest, and all spans.

    A null or empty text has none. Rows and other columns stay; columns of
    the same names are replaced.
    """

    def make():
        scanner = Scanner(novelty)

        def work(texts):
            found = [scanner.scan(t) for t in texts]
            return {k: [x[k] for x in found] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}

        return work

    return annotate(df, text, FIELDS, make, keep)


def redact_secrets(df: DataFrame, text: str = "text", novelty: float = NOVELTY) -> DataFrame:
    """Replace every span in the text column by ``[secret]``; null and empty texts stay as they are."""
    columns = df.columns

    def make():
        scanner = Scanner(novelty)
        return lambda texts: {text: [scanner.redact(t) for t in texts]}

    return annotate(df, text, f"`{text}` string", make).select(*[f"`{c}`" for c in columns])

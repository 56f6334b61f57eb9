"""Problem 6: noise in text from scanned pages, found and repaired.

A lexicon counts the words and hyphenated words of all sections; its most
frequent ``LEXICON`` entries are broadcast, so its size is bounded.  Two
averaged perceptrons are trained on clean text that is spoilt on purpose:

* a line model tells running headers, page numbers and text apart, from the
  shape of a line, its place on the page, its neighbours and the page number;
* a character editor chooses, for each rare token, between keeping it and the
  edits (keep, replace, delete, insert, join) that turn it into a lexicon word,
  scored by the characters read, those meant and their context.

Words divided at a line end are joined after furniture has been taken out, if
the whole is a word rather than its parts or the hyphenated form.

Defined results: null or empty text holds nothing and is repaired to nothing; a
record sent twice counts once; null keys are left out; a null page number is
unknown; tokens over 40 characters are kept as they are; empty tables give empty
results.  Only the named columns are read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.words import by_batch
from docsift.stage import Stage

#: Bound of the lexicon, of the training sample and of the length of a token that may be a word.
LEXICON, SAMPLE, LONGEST = 100_000, 400, 40
#: A token is looked at if its share of all tokens is below this.
RARE = 5e-5

_PART = re.compile(r"[^\W\d_]+")
_COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐][^\W\d_]+)+")
#: What may be a misread word: letters, digits and signs that stand for letters.
_TOKEN = re.compile(r"(?<![\w@†‡�|$€£§¢!])[\w@†‡�|$€£§¢!]*[^\W\d_][\w@†‡�|$€£§¢!]*")

# ---- perceptron ----------------------------------------------------------------


class Perceptron:
    """Averaged linear model over named features; the caller supplies the candidates."""

    def __init__(self):
        self.w: dict[str, float] = defaultdict(float)
        self._sum: dict[str, float] = defaultdict(float)
        self._at: dict[str, int] = defaultdict(int)
        self.steps = 0

    def score(self, features: list[str]) -> float:
        w = self.w
        return sum(w[f] for f in features if f in w)

    def update(self, right: list[str], wrong: list[str]) -> None:
        for features, sign in ((right, 1.0), (wrong, -1.0)):
            for f in features:
                self._sum[f] += (self.steps - self._at[f]) * self.w[f]
                self._at[f] = self.steps
                self.w[f] += sign

    def averaged(self) -> "Perceptron":
        for f in list(self.w):
            self._sum[f] += (self.steps - self._at[f]) * self.w[f]
        self.w = {f: s / max(1, self.steps) for f, s in self._sum.items() if s}
        self._sum, self._at = defaultdict(float), defaultdict(int)
        return self


# ---- character editor ------------------------------------------------------------

#: Characters as read and the characters that look like them.
LOOKALIKES = {
    "0": "o ö", "1": "l i", "3": "e", "5": "s", "6": "b ö g", "8": "b a", "9": "g q", "@": "a", "†": "t", "‡": "t", "|": "l i", "!": "l i", "$": "s", "€": "e c", "£": "e", "§": "s", "¢": "c",
    "rn": "m", "m": "rn in nn", "cl": "d", "d": "cl", "vv": "w", "w": "vv", "li": "h", "h": "li b", "ii": "u n ü", "ri": "n", "n": "ri u", "u": "ii n", "in": "m", "nn": "m", "ni": "m",
    "c": "e o", "e": "c o", "o": "c e", "f": "t", "t": "f l", "l": "i t", "i": "l j", "q": "g", "g": "q", "y": "v", "v": "y", "b": "h", "a": "o", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi",
    "c1": "d", "1i": "h", "iii": "m", "lo": "b", "ol": "d", "tl": "d", "fl": "h", "j": "i", "s": "5",
}
_READ = {k: v.split() for k, v in LOOKALIKES.items()}
_ANY = "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñóíáúîôû"
_SIGNS = set("@†‡�|$€£§¢!ﬁﬂﬀﬃ")


class Editor:
    """Chooses the intended word of a token as read."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon, self.model = lexicon, Perceptron()
        self.total = sum(lexicon.values()) or 1
        self.seen: dict[str, str | None] = {}
        self.raw: dict[str, str | None] = {}
        self.floor = max(3.0, self.total * RARE)

    def candidates(self, read: str) -> dict[str, list[tuple[str, str, int]]]:
        """Lexicon words that the token can be edited into, with their edits (read, meant, position).

        Signs and digits must be replaced; beside these, as few letters as lead to a word, at most two.
        """
        odd = {i for i, c in enumerate(read) if c.isdigit() or c in _SIGNS}
        sites: list[list[tuple[int, str]]] = []
        for i, c in enumerate(read):
            here = [(n, m) for n in (1, 2, 3) for m in _READ.get(read[i : i + n], ()) if i + n <= len(read)]
            sites.append(here + [(1, x) for x in _ANY] if c == "�" else here)
        lexicon = self.lexicon
        out: dict[str, list[tuple[str, str, int]]] = {}
        for free in range(0 if odd else 1, 3):
            stack: list[tuple[int, int, str, tuple]] = [(0, free, "", ())]
            while stack:
                i, left, made, edits = stack.pop()
                if not left and not any(j >= i for j in odd):
                    if (word := made + read[i:]) in lexicon and edits:
                        out.setdefault(word, list(edits))
                    continue
                for j in range(i, len(read)):
                    must = j in odd
                    for n, meant in sites[j]:
                        if must or left:
                            stack.append((j + n, left - (not must), made + read[i:j] + meant, (*edits, (read[j : j + n], meant, j))))
                    if must:
                        break
            if any(lexicon[w] >= self.floor for w in out):
                break  # a rare word may be misread itself, so the search goes on
        return out

    def features(self, read: str, word: str, edits: list[tuple[str, str, int]]) -> list[str]:
        own, count = self.lexicon.get(read, 0), self.lexicon.get(word, 0)
        out = [f"ratio {min(8, int(math.log2((count + 1) / (own + 1)))) if count else -1}", f"edits {len(edits)}", f"count {min(12, int(math.log2(count + 1)))}", f"length {min(8, len(word))}"]
        for obs, meant, i in edits:
            out += [f"op {obs}>{meant}", f"before {read[i - 1] if i else '^'} {obs}>{meant}", f"after {read[i + len(obs)] if i + len(obs) < len(read) else '$'} {obs}>{meant}"]
        return out

    def keep(self, read: str) -> list[str]:
        inner = any(c.isdigit() for c in read) and any(c.isalpha() for c in read)
        sign = any(c in _SIGNS for c in read)
        return ["keep", f"keep digit {inner}", f"keep sign {sign}", f"keep count {min(12, int(math.log2(self.lexicon.get(read, 0) + 1)))}", f"keep length {min(8, len(read))}"]

    def best(self, read: str) -> tuple[str, list[str]]:
        """The chosen word and its features."""
        top, chosen, what = self.model.score(f := self.keep(read)), read, f
        own, found = self.lexicon.get(read, 0), self.candidates(read)
        most = max((self.lexicon[w] for w in found), default=0)
        for word, edits in found.items():
            if self.lexicon[word] < max(20 * own + 3, most / 50, self.floor / 8):  # rarer ones are misread words themselves
                continue
            s = self.model.score(f := self.features(read, word, edits))
            if s > top:
                top, chosen, what = s, word, f
        return chosen, what

    def train(self, rng: random.Random, rounds: int = 3) -> None:
        """Spoil frequent words with look-alikes and learn to restore them, and to keep codes and rare words."""
        ordered = [w for w, _ in sorted(self.lexicon.items(), key=lambda x: (-x[1], x[0]))[:3000] if len(w) > 3 and "-" not in w]
        common = [w for w in ordered if self.lexicon[w] >= self.floor] or ordered[:300]
        spoil: dict[str, list[str]] = defaultdict(list)
        for obs, meant in _READ.items():
            for m in meant:
                spoil[m].append(obs)
        pairs = []
        for w in common:
            sites = [(i, n, obs) for i in range(len(w)) for n in (1, 2) for obs in spoil.get(w[i : i + n], ())]
            if not sites:
                continue
            for _ in range(3):
                i, n, obs = rng.choice(sites)
                read = w[:i] + obs + w[i + n :]
                if rng.random() < 0.4 and (more := [s for s in sites if s[0] >= i + n]):
                    j, m, obs2 = rng.choice(more)
                    read = w[:i] + obs + w[i + n : j] + obs2 + w[j + m :]
                if self.lexicon.get(read, 0) * 20 < self.lexicon[w]:
                    pairs.append((read, w))
            if rng.random() < 0.4:
                pairs.append((w, w))
        for _ in range(len(pairs) // 6):
            code = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(2, 7)))
            pairs.append((code, code))
        cached: dict[str, dict] = {}
        for _ in range(rounds):
            rng.shuffle(pairs)
            for read, truth in pairs:
                self.model.steps += 1
                chosen, what = self.best(read)
                if chosen != truth:
                    edits = [] if truth == read else cached.setdefault(read, self.candidates(read)).get(truth)
                    if edits is None:
                        continue
                    self.model.update(self.keep(read) if truth == read else self.features(read, truth, edits), what)
        self.model.averaged()

    def fixes(self, text: str) -> dict[str, str]:
        """Misread tokens of a text and the words they stand for."""
        raw, out = self.raw, {}
        for token in set(_TOKEN.findall(text)):
            if token not in raw:
                if len(raw) > 300_000:
                    raw.clear()
                raw[token] = self.word(token)
            if raw[token] is not None:
                out[token] = raw[token]
        return out

    def learn(self, tokens: dict[str, str | None]) -> None:
        """Take decisions made beforehand."""
        self.seen.update(tokens)

    def word(self, token: str) -> str | None:
        """The intended word if the token is misread, in the token's case; None if it stays."""
        if len(token) > LONGEST or len(token) < 3:
            return None
        body = token[1:]
        if body != body.lower() and token != token.upper():
            return None  # codes in mixed case
        if len(token) < 5 and token[0].isupper() and any(c.isdigit() for c in token) and sum(c.islower() for c in token) < 2:
            return None  # short codes
        low = token.lower()
        if token == token.upper() and any(c.isdigit() for c in token):
            return None  # codes in capitals
        if self.lexicon.get(low, 0) >= self.floor and not any(c in _SIGNS for c in low):
            return None
        if low not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            stem = low.strip("!|")
            chosen = self.best(low)[0] if sum(c.isalpha() for c in low) >= 2 and stem else low
            if chosen == low and stem != low and self.lexicon.get(stem, 0):
                chosen = low  # an exclamation mark, not a letter
            self.seen[low] = None if chosen in (low, stem) or len(chosen) < 3 else chosen
        got = self.seen[low]
        if got is None:
            return None
        return got.upper() if token == token.upper() and len(token) > 1 else got[0].upper() + got[1:] if not token[0].islower() and (token[0].isupper() or token[0].isdigit()) and token[0] != token[0].lower() else got


# ---- lines -----------------------------------------------------------------------

_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.I)
_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_PAGE = re.compile(r"\W*(?:(page|pages|p|pg|seite|s|página|pág|pagina|feuille|blatt|hoja|第)\b\.?)?[^\S\n]*\W{0,3}?(\d{1,4}|[ivxlcdm]{1,7})(?:\s*(?:/|of|von|sur|de|out of)\s*(\d{1,4}))?\s*(?:頁|页|ページ)?\W*", re.I)
_BESIDE = re.compile(r"^\W{0,3}(?:(?:page|p\.|seite)\s*)?(\d{1,4})(?:\s{2,}|\t|\s+[|–—*·•-]+\s+)(?=\S*[^\W\d_])|(?:\s{2,}|\t|\s+[|–—*·•-]+\s*|\s*[|*]\s*)(?:(?:page|p\.|seite)\s*)?(\d{1,4})\W{0,3}$", re.I)
_BULLET = re.compile(r"\s*(?:[•·*–—-]|\d{1,3}[.)]|[a-z][.)]|\d+(?:\.\d+)+)\s+")
#: A class of paper before a title: one or two words, the first with a capital, and a separator.
_LABEL = re.compile(r"(?:\d{1,4}\s+(?:[|–—*·•-]\s+)?)?(?=[^\W\d_])[^a-zß-öø-ÿ\W\d_][^\W\d_]+(?: [^\W\d_]+)?\s*[:–—·|-]\s+\S")
_STOP = re.compile(r"[.!?。！？:;,][\"'”’»)]*\s*$")


def roman(s: str) -> int | None:
    """Value of a Roman numeral."""
    s = s.lower()
    if not s or not _ROMAN.fullmatch(s):
        return None
    v = [_VALUES[c] for c in s]
    return sum(-a if b > a else a for a, b in zip(v, v[1:] + [0]))


def page_mark(line: str, page: int | None) -> tuple[bool, bool] | None:
    """(equals the page number, has a word or signs around it) if the line holds nothing but a number."""
    m = _PAGE.fullmatch(line)
    if not m:
        return None
    n = int(m[2]) if m[2].isdigit() else roman(m[2])
    if n is None:
        return None
    return n == page, bool(m[1] or m[3]) or line.strip() != m[2]


def beside(line: str, page: int | None) -> bool:
    """A page number set apart at an end of the line."""
    m = _BESIDE.search(line)
    return bool(m) and (page is None or int(m[1] or m[2]) == page)


def line_features(lines: list[str], k: int, page: int | None, width: int) -> list[str]:
    """Shape, place, neighbours and page number of line k, which is not blank."""
    s = lines[k].strip()
    before = next((lines[i].strip() for i in range(k - 1, -1, -1) if lines[i].strip()), "")
    after = next((lines[i].strip() for i in range(k + 1, len(lines)) if lines[i].strip()), "")
    mark = page_mark(s, page)
    ws = [w for w in _PART.findall(s) if len(w) > 2 or w[0].isupper()]
    titled = sum(w[0].isupper() for w in ws) / len(ws) if ws else 0
    caps = bool(ws) and all(w == w.upper() for w in ws)
    alone = not (k and lines[k - 1].strip()) and not (k + 1 < len(lines) and lines[k + 1].strip())
    flows = bool(before) and not _STOP.search(before) and after[:1].islower()
    cut = bool(before) and not re.search(r"[.!?。！？:][\"'”’»)]*$", before)
    label = bool(_LABEL.match(s)) and len(s) < 70
    place = "only" if len(lines) == 1 else "first" if not before else "last" if not after else "middle"
    if mark:
        kind = "number"
    else:
        kind = "text"
    near = [page_mark(x, page) for x in (before, after) if x]
    numbers = sum(1 for m in near if m and not m[1] and not (m[0] and page))
    return [
        f"{kind} bias", f"{kind} {place}", f"{kind} alone {alone}", f"{kind} flows {flows}", f"{kind} cut {cut}", f"{kind} short {len(s) < 0.75 * width}", f"{kind} stop {bool(_STOP.search(s))}",
        f"{kind} titled {int(titled * 4)} caps {caps}", f"{kind} titled {titled >= 0.75 and len(ws) > 1} cut {cut}", f"{kind} titled {titled >= 0.75 and len(ws) > 1} alone {alone}", f"{kind} words {min(9, len(ws))}",
        f"{kind} titled {titled >= 0.75 and len(ws) > 1} short {len(s) < 0.9 * width} stop {bool(_STOP.search(s))} bullet {bool(_BULLET.match(s))} {place}", f"{kind} titled {titled >= 0.75 and len(ws) > 1} flows {flows} bullet {bool(_BULLET.match(s))}",
        f"{kind} label {label} cut {cut} short {len(s) < 0.75 * width}", f"{kind} bullet {bool(_BULLET.match(s))}", f"{kind} beside {beside(lines[k], page) and titled >= 0.5}", f"{kind} page {mark[0] if mark else None} {page is None}",
        f"{kind} signs {mark[1] if mark else None} {page is None}", f"{kind} numbers {numbers} page {mark[0] if mark else None}", f"{kind} lower {s[:1].islower()}",
    ]


CLASSES = ("text", "header", "pageno")


class Lines:
    """Line model: text, header or pageno."""

    def __init__(self):
        self.model = Perceptron()

    def best(self, features: list[str]) -> str:
        return max(CLASSES, key=lambda c: (self.model.score([f"{c} {f}" for f in features]), c == "text"))

    def train(self, texts: list[str], rng: random.Random, rounds: int = 7) -> None:
        """Wrap clean texts into lines, insert invented headers, page numbers, lists, headings and columns of figures."""
        nouns = ["Handbook", "Report", "Manual", "Minutes", "Guide", "Protocol", "Checklist", "Summary", "Plan", "Review", "Bulletin", "Notes"]
        pool = [w for t in texts for w in _PART.findall(t) if len(w) > 3][:20_000] or ["sample", "pages", "scanned"]
        examples = []
        for t in texts:
            flat = " ".join(t.split())
            if len(flat) < 150:
                continue
            for _ in range(5):
                examples.append(self._page(flat, pool, nouns, rng))
        for _ in range(rounds):
            rng.shuffle(examples)
            for lines, labels, page in examples:
                width = _width(lines)
                for k, label in enumerate(labels):
                    if label is None:
                        continue
                    self.model.steps += 1
                    f = line_features(lines, k, page, width)
                    got = self.best(f)
                    if got != label:
                        self.model.update([f"{label} {x}" for x in f], [f"{got} {x}" for x in f])
        self.model.averaged()

    @staticmethod
    def _page(flat: str, pool: list[str], nouns: list[str], rng: random.Random) -> tuple[list[str], list[str | None], int | None]:
        width = rng.choice([45, 60, 72, 80])
        lines, row = [], ""
        for w in flat.split(" ")[:220]:
            if row and len(row) + len(w) + 1 > width:
                lines.append(row)
                row = w
            else:
                row = f"{row} {w}" if row else w
        lines.append(row)
        labels: list[str | None] = ["text"] * len(lines)
        page = rng.choice([None, *range(1, 60), *range(1, 30)])
        number = page or rng.randint(1, 60)
        words = [rng.choice(pool) for _ in range(rng.randint(1, 3))]
        title = rng.choice([" ".join(words).title() + " " + rng.choice(nouns), f"{rng.choice(['Internal', 'Restricted', 'Draft', 'Confidential', 'Preliminary', 'For review', 'Working copy', 'For comment', 'Second draft', 'Not final'])}{rng.choice([' – ', ': ', ' · ', ' | '])}{' '.join(words).lower()}"])
        title += rng.choice(["", "", f" – {rng.choice(['Issue', 'Rev.', 'Chapter', 'Volume', 'Unit', 'Part'])} {rng.randint(1, 20)}"]) + rng.choice(["", "", "", " (continued)", " *", " file", f"  rev. {rng.randint(1, 5)}"])

        def put(at: int, new: str, label: str) -> None:
            rows = ["", new, ""] if rng.random() < 0.5 else [new]
            lines[at:at] = rows
            labels[at:at] = [label if r else None for r in rows]

        inside = lambda: rng.randint(1, max(1, len(lines) - 1))
        style = rng.random()
        if style < 0.45:
            text = rng.choice([title, title, title.upper()])
            if rng.random() < 0.35:
                text = rng.choice([f"{text}   {number}", f"{text}\t{number}", f"{number}   {text}", f"{text} – {number}", f"{text} | {number}", f"{text} * – {number}"])
            put(inside(), text, "header")
        if style > 0.3 and style < 0.75:
            low = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv xvi xvii xviii xix xx".split()
            marks = [f"– {number} –", f"- {number} -", f"Page {number}", f"p. {number}", f"[{number}]", f"{number}/{number + rng.randint(1, 40)}", f"page {number} of {number + 9}", f"~ {number} ~", f"({number})"]
            if page:
                marks += [str(number), str(number), low[number - 1] if number <= 20 else str(number)]
            put(inside(), rng.choice(marks), "pageno")
        if rng.random() < 0.25:
            rows = [str(rng.randint(1, 999)) for _ in range(rng.randint(3, 9))]
            if page and rng.random() < 0.6:
                rows[rng.randrange(len(rows))] = str(page)
            lines += ["Readings of the " + rng.choice(pool) + ", one per line:", *rows]
            labels += ["text"] * (len(rows) + 1)
        if rng.random() < 0.25:
            mark = rng.choice(["•", "-", "*", "–"])
            rows = [f"{mark if rng.random() < 0.7 else str(i) + ')'} {rng.choice(pool)} {rng.choice(pool)}" for i in range(1, rng.randint(3, 8))]
            lines += ["Tick off:", *rows]
            labels += ["text"] * (len(rows) + 1)
        if rng.random() < 0.3:
            lines[0:0] = [rng.choice([f"{rng.randint(1, 9)}.{rng.randint(1, 9)} {rng.choice(pool).title()} {rng.choice(pool)}", f"{rng.choice(pool).title()} {rng.choice(pool)}"])]
            labels[0:0] = ["text"]
        return lines, labels, page


def _width(lines: list[str]) -> int:
    return max(sorted(len(x) for x in lines if x.strip())[-3:][0], 30) if any(x.strip() for x in lines) else 30


#: A number that its frame alone marks as a page number.
_FRAMED = re.compile(r"(?:page|p\.|seite|página|pág\.)\s*\S+(?:\s+\S+\s+\d+)?|[–—~-]\s*\w+\s*[–—~-]|\[\s*\d+\s*\]", re.I)
_LOWER = re.compile(r"(?<![^\W_])[a-zß-öø-ÿ]{3,}")


def furniture(lines: list[str], page: int | None, model: Lines) -> dict[int, str]:
    """Line number -> header or pageno.  Lines that begin in lower case or hold running prose are not looked at."""
    if len(lines) < 2:
        return {}
    out = {}
    width = 0
    for k, x in enumerate(lines):
        s = x.strip()
        if not s or len(s) > 90 or s[0] > "\u2e7f" and s[0] != "�" or s[0].islower() and len(s) > 16:
            continue
        mark = page_mark(s, page) if len(s) < 25 else None
        if not mark and (s[0].islower() or len(_LOWER.findall(s)) > 3 and not _LABEL.match(s)):
            continue
        if not mark and _STOP.search(s) and not beside(x, page):
            continue
        width = width or _width(lines)
        label = model.best(line_features(lines, k, page, width))
        if label == "pageno" and not mark:
            label = "header"
        if mark and (mark[0] or page is None) and _FRAMED.fullmatch(s):
            label = "pageno"
        if label != "text":
            out[k] = label
    return out


# ---- divided words -----------------------------------------------------------------

#: Signs read at the end of a divided word: hyphens, the not sign, and dashes in their place.
_BREAK = re.compile("([^\\W\\d_]+)(?:([-\u2010\u2011\u00ad\u00ac–—−])[ \\t]*\\r?\\n\\s*|([-\u2010\u2011–—−])[ \\t]+|([\u00ad\u00ac])[ \\t]*)([^\\W\\d_]+)")
_MARKS = frozenset("-\u2010\u2011\u00ad\u00ac–—−")
_SUSPENDED = set("and or und oder et ou y o e u to bis as als".split())


def divided(a: str, b: str, editor: Editor) -> bool:
    """a- and b are one word broken at a line end, not a compound or a suspended hyphen."""
    a, b = a.lower(), b.lower()
    if b in _SUSPENDED:
        return False
    n = editor.lexicon
    whole, compound = n.get(a + b, 0), n.get(f"{a}-{b}", 0)
    if compound > whole:
        return False
    if whole:
        return whole >= 2 * compound and whole > min(n.get(a, 0), n.get(b, 0)) / 50
    if editor.word(a + b):
        return True
    return n.get(a, 0) < editor.floor and n.get(b, 0) < editor.floor and len(a) > 1 and len(b) > 1


def examine(text: str | None, page: int | None, editor: Editor, lines_model: Lines) -> tuple[list[str], str]:
    """(kinds of noise, repaired text)."""
    if not text or not text.strip():
        return [], ""
    kinds = set()
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    found = furniture(lines, page, lines_model)
    for k, label in found.items():
        kinds.add(label)
        if label == "header" and beside(lines[k], page):
            kinds.add("pageno")
    if found:
        kept: list[str] = []
        for k, x in enumerate(lines):
            if k in found or (not x.strip() and (k - 1 in found or k + 1 in found)):
                continue
            kept.append(x)
        lines = kept
    body = "\n".join(lines)
    if not _MARKS.isdisjoint(body):

        def joined(m: re.Match) -> str:
            if divided(m[1], m[5], editor):
                kinds.add("hyphen")
                return m[1] + m[5]
            return m[0] if not (m[2] or m[4]) or (m[2] or "") in "–—−" else f"{m[1]}-{m[5]}"

        body = _BREAK.sub(joined, body)
    fixes = editor.fixes(body)
    wrong = 0
    if fixes:

        def restored(m: re.Match) -> str:
            nonlocal wrong
            word = fixes.get(m[0])
            wrong += word is not None
            return word or m[0]

        body = _TOKEN.sub(restored, body)
    if wrong >= 3:
        kinds.add("chars")
    paragraphs = re.split(r"\n[ \t]*\n\s*", body)
    out = []
    for p in paragraphs:
        rows = [r.strip() for r in p.split("\n") if r.strip()]
        whole = ""
        for r in rows:
            whole = r if not whole else f"{whole}\n{r}" if _BULLET.match(r) or re.search(r"[:：]$", whole) else whole + ("" if re.search(r"[぀-ヿ㐀-鿿。、，]$", whole) else " ") + r
        out.append(whole)
    return sorted(kinds), "\n\n".join(x for x in out if x)


# ---- Spark -------------------------------------------------------------------------


def lexicon(df: DataFrame, text: str = "section_text") -> dict[str, int]:
    """Counts of the most frequent words and hyphenated words over the distinct texts, so copies don't vote their misreadings in."""

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            seen: Counter = Counter()
            for t in batch.column(0).to_pylist():
                low = t.lower()
                seen.update(_PART.findall(low))
                if "-" in low:
                    seen.update(_COMPOUND.findall(low))
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"]) if seen else None

        return run

    counts = by_batch(df.select(F.col(text)).filter(F.col(text).isNotNull()).distinct(), make, "w string, n long").filter(F.length("w") <= LONGEST)
    counted = Stage(df.sparkSession, "scans").save(counts.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1"), "words")
    # the count from which at most LEXICON words are kept, so that no more than these reach the driver
    least, kept = 2, 0
    for r in counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        kept += r.words
        if kept > LEXICON:
            least = r.n + 1
            break
    return {r.w: r.n for r in counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "w").collect()}


def models(df: DataFrame, key: str, text: str, page: str) -> tuple[Editor, Lines]:
    """The trained editor and line model."""
    rng = random.Random(11)
    editor, lines_model = Editor(lexicon(df, text)), Lines()
    clean = df.filter(F.col(page).isNull() & F.col(text).isNotNull() & (F.length(text) > 150) & (F.length(text) < 5000)).select(text, F.xxhash64(key).alias("h"))
    chosen = [r.h for r in clean.select("h").orderBy("h").limit(SAMPLE).collect()]  # hashes only: every task sends as many
    sample = clean.filter(F.col("h") <= max(chosen)).orderBy("h", text).collect() if chosen else []
    lines_model.train([r[0] for r in sample], rng)
    editor.train(rng)
    editor.seen.clear()
    # the rare words of the lexicon are decided once, not in every task
    rare = [w for w, n in editor.lexicon.items() if n < editor.floor]
    if rare:
        shared = df.sparkSession.sparkContext.broadcast(editor)

        def make():
            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                words = batch.column(0).to_pylist()
                return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.word(w) for w in words], pa.string())], ["w", "fix"])

            return run

        decided = by_batch(df.sparkSession.createDataFrame([(w,) for w in rare], "w string").repartition(24), make, "w string, fix string")
        editor.learn({r.w: r.fix for r in decided.collect()})
    return editor, lines_model


def examined(df: DataFrame, key: str = "section_id", text: str = "section_text", page: str = "page_number") -> DataFrame:
    """section_id, kinds, repaired of every section, once per key."""
    spark = df.sparkSession
    trained = spark.sparkContext.broadcast(models(df, key, text, page))
    rows = df.select(F.col(key).cast("long").alias("section_id"), F.col(text).alias("t"), F.col(page).cast("int").alias("p")).filter("section_id is not null and t is not null")

    def make():
        editor, lines_model = trained.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds, repaired = [], []
            for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                k, r = examine(t, p, editor, lines_model)
                kinds.append(k)
                repaired.append(r)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(repaired, pa.string())], ["section_id", "kinds", "repaired"])

        return run

    return by_batch(rows, make, "section_id long, kinds array<string>, repaired string")


def found(df: DataFrame) -> DataFrame:
    """section_id, noise: one row for each kind of noise a section holds."""
    return examined(df).select("section_id", F.explode("kinds").alias("noise")).distinct()


def repaired(df: DataFrame) -> DataFrame:
    """section_id, repaired: the text of each section that held noise, in continuous paragraphs."""
    return examined(df).filter(F.size("kinds") > 0).select("section_id", "repaired").dropDuplicates(["section_id"])

"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans, which always stay. The field scores whole
candidate segments (their shape, digits, checksum and neighbours) and a dynamic program over segments of bounded length
chooses boundaries and types together; it adds spans, for example card
numbers without a valid checksum or telephone numbers without a plus sign. It is trained here, on
sentences made from a fixed seed.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Tokens in a segment at most.
LONGEST = 20
SENTENCES = 500
#: Segments whose score a worker keeps.
SEEN = 1 << 16
EPOCHS = 8
SEED = 11

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[^0-9]")


def octet(digits: str) -> bool:
    """Whether the number is at most 255, however many zeros it begins with."""
    rest = digits.lstrip("0")
    return len(rest) < 4 and int(rest or "0") < 256


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: around each @ that has not been passed, the longest run before and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by the fixed patterns, kind by kind leftmost and not overlapping; sorted by start, then kind."""
    found = [(b, e, 0) for b, e in emails(text)]
    for m in _IP.finditer(text):
        if all(octet(x) for x in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = _DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# --- the field -------------------------------------------------------------

#: Words with a digit or an @, and what stands between them, make a region; no segment leaves its region.
#: Parts without one are passed over whole, so that the time stays in proportion to the text.
_REGION = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:[ \t]{1,2}[^\s0-9@]*+[0-9@]\S*+)*+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_BEFORE = re.compile(r"([^\W\d_]+)[^\w]*$")


def token_class(token: str) -> str:
    first = token[0]
    if first.isdigit() and first.isascii():
        n = len(token)
        return "d" + (str(n) if n < 5 else "5-9" if n < 10 else "10-13" if n < 14 else "14-19" if n < 20 else "20+")
    if first.isalpha():
        return "L"
    return " " if first.isspace() else first


class Region:
    """Tokens of a stretch of text, with the word before it."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.start = text, start
        spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]
        self.spans = spans
        self.classes = [token_class(text[b:e]) for b, e in spans]
        m = _BEFORE.search(text, max(0, start - 40), start)
        self.before = m[1].lower() if m else ""

    def segments(self) -> Iterator[tuple[int, int]]:
        """Token ranges that may be entities.

        They begin and end with a word or number that goes no further, and are without white space around one @,
        or numbers with signs and spaces between them, of 7 to 20 digits or with three dots.
        """
        classes, n = self.classes, len(self.classes)
        solid = [c[0] in "Ld" for c in classes] + [False]
        for i in range(n):
            if not solid[i] and classes[i] not in "+(" or i and solid[i] and solid[i - 1]:
                continue
            digits = ats = dots = 0
            words = spaces = False
            for j in range(i, min(n, i + LONGEST)):
                c = classes[j]
                if c[0] == "d":
                    digits += self.spans[j][1] - self.spans[j][0]
                elif c == "L" or c == "@":
                    words, ats = True, ats + (c == "@")
                elif c == " ":
                    spaces = True
                elif c == ".":
                    dots += 1
                elif c not in "-+()/_%":
                    break
                if words and spaces or ats > 1 or digits > 20 and not words:
                    break
                if solid[j] and not solid[j + 1] and (ats == 1 if words else digits >= 7 or (dots == 3 and digits >= 4)):
                    yield i, j + 1

    def facts(self, i: int, j: int) -> tuple:
        """All that the features of a segment depend on: its classes and neighbours, digits, whether it is four octets and has a checksum, and the word before."""
        classes = self.classes[i:j]
        words = self.text[self.spans[i][0] : self.spans[j - 1][1]]
        digits = _DIGIT.sub("", words)
        parts = words.split(".")
        four = all(octet(x) and len(x) < 4 for x in parts) if len(parts) == 4 and all(x.isdigit() and x.isascii() for x in parts) else None
        checked = luhn(digits) if 13 <= len(digits) <= 19 and not {c[0] for c in classes} - set("d -") else None
        left = self.classes[i - 1][0] if i else "^"
        right = self.classes[j][0] if j < len(self.classes) else "$"
        zeros = len(digits) - len(digits.lstrip("0")) if digits[:1] == "0" else 0
        return tuple(classes), left, right, len(digits), four, checked, min(zeros, 2), self.before if i == 0 else ""


def features(facts: tuple) -> list[str]:
    """Features of the whole segment."""
    classes, left, right, n, four, checked, zeros, word = facts
    simple = "".join(c[0] for c in classes)
    out = ["bias", "shape=" + re.sub(r"((?:[Ld][._%+-])+)(?=[Ld])", "~", simple)[:24], "exact=" + "".join(classes)[:40], f"digits={n if n < 20 else 20}", "left=" + left, "right=" + right]
    if "@" in classes:
        at = simple.index("@")
        out += ["at", f"at={simple[max(0, at - 1):at + 2]}", f"dots={min(simple[at:].count('.'), 3)}", f"ats={simple.count('@')}"]
    else:
        out.append("no-at")
    if four is not None:
        out.append("octets" if four else "not-octets")
    if checked is not None:
        out += ["long", "luhn" if checked else "no-luhn"]
    if classes[0] == "+":
        out.append("plus")
    if "(" in classes:
        out.append("bracket" if simple.count("(") == simple.count(")") else "open")
    if zeros:
        out += [f"zeros={zeros}", f"zeros={zeros} digits={n}", f"zeros={zeros} exact=" + "".join(classes)[:40]]
    if word:
        out.append("word=" + word)
        if four is None and "@" not in classes:
            out.append(f"word={word} digits={n}")
    return out


class Field:
    """Weights of features for the four kinds and for a token outside of entities."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))
        self.outside = np.zeros(8)
        self.seen: dict[tuple, tuple[float, int]] = {}

    #: classes of single outside tokens
    OUT = {"L": 0, "d": 1, " ": 2, "@": 3, "+": 4, ".": 5, "(": 6}

    def outside_ids(self, region: Region) -> np.ndarray:
        return np.array([self.OUT.get(c[0], 7) for c in region.classes], dtype=np.int64)

    def known(self, names: list[str], grow: bool) -> list[int]:
        if grow:
            for x in names:
                self.ids.setdefault(x, len(self.ids))
        return [self.ids[x] for x in names if x in self.ids]

    def lattice(self, region: Region, grow: bool = False) -> list[tuple[int, int, list[int]]]:
        return [(i, j, self.known(features(region.facts(i, j)), grow)) for i, j in region.segments()]

    def best(self, facts: tuple) -> tuple[float, int]:
        """Score and number of the best kind for a segment; segments of equal facts are scored once."""
        known = self.seen.get(facts)
        if known is None:
            if len(self.seen) >= SEEN:
                self.seen.clear()
            score = self.weights[self.known(features(facts), False)].sum(axis=0)
            k = int(score.argmax())
            known = self.seen[facts] = float(score[k]), k
        return known

    def train(self, examples: list[tuple[Region, list[tuple[int, int, int]]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Gradient ascent on the likelihood of whole segmentations (AdaGrad), by sums forward and backward."""
        ready = [(self.lattice(r, True), self.outside_ids(r), {(i, j): k for i, j, k in gold}) for r, gold in examples]
        self.weights = np.zeros((len(self.ids), len(KINDS)))
        seen, seen_out = np.full(self.weights.shape, 1e-6), np.full(8, 1e-6)
        order = random.Random(SEED)
        for _ in range(epochs):
            order.shuffle(ready)
            for lattice, out_ids, gold in ready:
                grad, grad_out = self.gradient(lattice, out_ids, gold)
                rows = list(grad)
                g = np.array([grad[r] for r in rows]).reshape(len(rows), len(KINDS)) - decay * self.weights[rows]
                seen[rows] += g * g
                self.weights[rows] += rate * g / np.sqrt(seen[rows])
                seen_out += grad_out * grad_out
                self.outside += rate * grad_out / np.sqrt(seen_out)

    def gradient(self, lattice, out_ids, gold):
        n = len(out_ids)
        score = [self.weights[ids].sum(axis=0) for _, _, ids in lattice]
        out = self.outside[out_ids]
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (_, j, _) in enumerate(lattice):
            ending[j].append(s)
        total = [math.log(np.exp(x - x.max()).sum()) + x.max() for x in score]
        ahead = np.zeros(n + 1)
        for j in range(1, n + 1):
            terms = [ahead[j - 1] + out[j - 1]] + [ahead[lattice[s][0]] + total[s] for s in ending[j]]
            ahead[j] = np.logaddexp.reduce(terms)
        back = np.full(n + 1, -np.inf)
        back[n] = 0.0
        for j in range(n, 0, -1):
            back[j - 1] = np.logaddexp(back[j - 1], back[j] + out[j - 1])
            for s in ending[j]:
                i = lattice[s][0]
                back[i] = np.logaddexp(back[i], back[j] + total[s])
        grad: dict[int, np.ndarray] = {}
        for s, (i, j, ids) in enumerate(lattice):
            p = np.exp(ahead[i] + score[s] + back[j] - ahead[n])
            g = -p
            if (i, j) in gold:
                g[gold[i, j]] += 1
            if np.abs(g).max() > 1e-6:
                for f in ids:
                    grad[f] = grad[f] + g if f in grad else g.copy()
        p_out = np.exp(ahead[:-1] + out + back[1:] - ahead[n])
        covered = np.zeros(n, dtype=bool)
        for i, j in gold:
            covered[i:j] = True
        grad_out = np.bincount(out_ids, weights=(~covered) - p_out, minlength=8)
        return grad, grad_out

    def decode(self, region: Region) -> list[tuple[int, int, int]]:
        """(start, end, kind) in the text of the best segmentation."""
        n = len(region.classes)
        ending: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for i, j in region.segments():
            ending[j].append((i, *self.best(region.facts(i, j))))
        out = self.outside[self.outside_ids(region)].tolist()
        best, step = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        for j in range(1, n + 1):
            best[j], step[j] = best[j - 1] + out[j - 1], (j - 1, -1)
            for i, score, k in ending[j]:
                if best[i] + score > best[j]:
                    best[j], step[j] = best[i] + score, (i, k)
        found, j = [], n
        while j:
            i, k = step[j]
            if k >= 0:
                found.append((region.spans[i][0], region.spans[j - 1][1], k))
            j = i
        return found[::-1]


# --- training sentences ----------------------------------------------------


def _entity(kind: int, rng: random.Random) -> str:
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(rng.randint(a, b)))
    if kind == 0:
        local = rng.choice([f"{word(2, 8)}.{number(2)}", f"{word(1, 3)}.{word(3, 8)}{number(1)}", f"{word(3, 8)}{number(3)}", f"{word(3, 6)}_{number(2)}", word(3, 9)])
        host = rng.choice([f"{word(3, 6)}{number(1)}.{word(3, 8)}.{word(2, 3)}", f"{word(3, 9)}{number(1)}.{word(2, 3)}"])
        return f"{local}@{host}"
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        digits = str(rng.randint(3, 9)) + number(rng.choice([13, 14, 15, 15, 15, 15, 15]))
        if rng.random() < 0.4:
            digits = next(digits[:-1] + c for c in "0123456789" if luhn(digits[:-1] + c))
        return rng.choice([digits, " ".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "-".join(digits[i : i + 4] for i in range(0, len(digits), 4))] + [digits] * 2)
    a, b, c = number(3), number(3), number(4)
    if rng.random() < 0.4:  # numbers as they are dialled inside a country, and with 00 for the plus sign
        return rng.choice([f"0{rng.randint(10, 29)} {number(4)} {c}", f"07{number(3)} {number(6)}", f"0{rng.randint(100, 999)} {number(6)}", f"0{rng.randint(100, 999)} {a} {c}", f"0800 {c}", f"0800 {a} {c}", f"00{rng.randint(20, 99)} {number(2)} {number(6)}", f"00{rng.randint(20, 99)} {a} {number(7)}", f"0{rng.randint(1, 9)} {number(2)} {number(2)} {number(2)} {number(2)}"])
    return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(20, 99)} {rng.randint(100, 999)} {number(7)}", f"+1{a}{b}{c}", f"{a}.{b}.{c}", f"+44 {number(4)} {number(6)}"])


def _other(rng: random.Random) -> str:
    number = lambda n: str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(n - 1))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    return rng.choice([
        f"20{number(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 12)}:{rng.randint(10, 59)}", f"{number(1)}.{number(1)}", f"{number(1)}.{number(1)}.{number(1)}", f"{number(4)}.", f"{number(2)}%", f"${number(3)}.{number(2)}",
        f"#{number(5)}", f"{number(8)}", f"{number(6)}", f"{number(3)},{number(3)}", f'"{hexa(40)}"', hexa(32), f"{hexa(8)}-{hexa(4)}-{hexa(4)}", f"v{number(1)}.{number(1)}", f"1{number(3)}-1{number(3)}", f"@{hexa(5)}", f"x{number(2)}@", f"{number(24)}", f"{number(1)}.{number(1)},", f"{number(10)}", f"ISBN {number(3)}-{number(1)}-{number(4)}-{number(4)}-{number(1)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{number(4)}", f"{rng.randint(256, 999)}.{number(3)}.{number(3)}.{number(3)}", f"{number(1)}.{number(rng.randint(7, 17))}", f"{number(2)}.{number(6)}, {number(2)}.{number(6)}",
        *[f"{rng.choice(['order', 'id', 'ref', 'no', 'ticket', 'invoice'])}{rng.choice([' ', ': ', ' #'])}{x}" for x in (f"20{number(2)}{rng.randint(10, 12)}{rng.randint(10, 28)}{number(6)}", number(16), number(rng.randint(9, 15)), f"0{number(8)}", f"{number(4)} {number(4)} {number(4)}")], f"20{number(2)}{rng.randint(10, 12)}{rng.randint(10, 28)}{number(6)}", f"{number(7)}-{number(7)}", f"{number(6)}-{number(6)}", f"{number(5)}-{number(6)}", f"0{number(5)}", f"00{number(4)}",
        " ".join(number(rng.randint(1, 3)) for _ in range(rng.randint(3, 9))), " ".join(number(3) for _ in range(rng.randint(3, 7))), number(1) + (" " + number(3)) * rng.randint(2, 4), " ".join(f"{number(rng.randint(1, 3))}.{number(2)}" for _ in range(rng.randint(2, 6))), f"{number(2)}-{number(2)}, {number(2)}-{number(2)}", f"0.{number(15)}", f"{number(1)}.{number(15)}",
    ])


def training_sentences(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with the spans of their entities, and numbers of other kinds between them."""
    rng = random.Random(seed)
    cues = [["mail", "email", "write"], ["ip", "host", "server"], ["card", "paid", "visa"], ["call", "phone", "tel"]]
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            filler = " ".join("".join(rng.choice("aeiourstnl") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(0, 4)))
            text += (filler + " ") if filler else ""
            if rng.random() < 0.55:
                kind = rng.randrange(4)
                if rng.random() < 0.2:
                    text += rng.choice(cues[kind]) + rng.choice([" ", ": "])
                word = _entity(kind, rng)
                text += rng.choice(["", "", "", "(", '"'])
                spans.append((len(text), len(text) + len(word), kind))
                text += word + rng.choice([" ", " ", ". ", ", ", ") ", "!! ", "*** ", "$$$ ", " | "])
            else:
                text += _other(rng) + rng.choice([" ", " ", ". ", ", ", "### ", "&&& "])
        out.append((text, spans))
    return out


def regions(text: str) -> Iterator[Region]:
    """The stretches of a text in which entities are looked for."""
    for m in _REGION.finditer(text):
        yield Region(text, m.start(), m.end())


def examples(sentences) -> list[tuple[Region, list[tuple[int, int, int]]]]:
    out = []
    for text, spans in sentences:
        for region in regions(text):
            starts = {b: i for i, (b, _) in enumerate(region.spans)}
            ends = {e: i + 1 for i, (_, e) in enumerate(region.spans)}
            gold = [(starts[b], ends[e], k) for b, e, k in spans if b in starts and e in ends]
            out.append((region, gold))
    return out


@lru_cache(maxsize=2)
def trained(count: int = SENTENCES, seed: int = SEED) -> Field:
    field = Field()
    field.train(examples(training_sentences(count, seed)))
    return field


def all_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """The base spans and those spans of the field that overlap none of them."""
    found, starts, ends = list(base), [b for b, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    for region in regions(text):
        for b, e, k in field.decode(region):
            before = bisect_left(starts, e)
            if not before or ends[before - 1] <= b:
                found.append((b, e, k))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for b, e, k in spans)


def find_personal_data(docs: DataFrame, sentences: int = SENTENCES) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans: these and what the field adds.

    Offsets are code points, ends exclusive. Null and empty texts have no spans.
    Repeated rows give equal rows. A very long text is searched whole, region by region. Further columns are left out, so none
    can clash; an empty table gives an empty one.
    """
    field = trained(sentences)
    shared = docs.sparkSession.sparkContext.broadcast((field.ids, field.weights, field.outside))
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] * 2

    def run(batches):
        model = Field()
        model.ids, model.weights, model.outside = shared.value
        some = re.compile("[0-9@]")
        none = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")

        def one(text: str | None) -> tuple:
            if not text or not some.search(text):
                return none
            base = base_spans(text)
            counts = [sum(k == x for _, _, k in base) for x in range(4)]
            return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(text, base, model)))

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [one(x.as_py()) for x in part.column(1)]
                columns = [pa.array(list(x), t) for x, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

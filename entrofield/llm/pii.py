"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

Entities: e-mail addresses, IPv4 addresses, phone numbers, account and card numbers (13-19 digits), social-security numbers, IBANs with valid check digits,
labelled secrets (token = ...), and person names. A name is a known given name, a title (Mr, Dr, ...) or a cue ("my name is", "Name:" at the beginning of a line) before a capitalised
word; a capitalised word after a given name is the surname, and later mentions of that surname are found too. Names without any of these are not found.

A surrogate is a permutation of the entity within its format. The characters that carry information become digits of mixed radix: digits, letters of one
script (in names: vowels and consonants apart; in secrets: hexadecimal letters and others apart), octets, or the given names of one script and gender. A keyed
Feistel network P over such strings gives x -> P^-1(P(x) + 1), a permutation without fixed points. Where the format is a part of these strings, the permutation is
repeated until its result is in it. So
- distinct entities get distinct surrogates and equal ones equal surrogates, over the whole corpus and in every rerun, without shared state;
- no entity is its own surrogate (a name only where it has one letter to change); punctuation, lengths, letter case, calling codes, top-level domains, check digits
  and validity stay. Private, loopback, link-local, multicast and reserved addresses stay in their range, public ones public;
- surnames of one family keep their stem in common and each its gendered ending (Ivanov, Ivanova); given names that aren't in the lists are permuted by letter before
  an ending that tells their gender.
The collision check counts, per document, distinct entities with equal surrogates (`collisions`, 0 by construction); collision_report() does so over the corpus.

Spelling variants in separators are one entity, and those in letter case except in secrets. "+1 555 123 4567" and "+15551234567" are one number: the calling code is
read by the table of codes, and a number without one is another format. Null and empty texts stay as they are, without entities. Repeated rows get equal
results. Other columns, and their order, are kept by pseudonymise(); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_whole, slices

DIGITS = "0123456789"
#: Letters that replace one another.
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώς")
#: In names vowels replace vowels.
SOUNDS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αειουηωάέίόύήώ", "βγδζθκλμνξπρσςτφχψ")
#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Amelia Beatrice Catherine Charlotte Christina Claudia Deborah Elizabeth Emily Friederike Gabriele Guadalupe Isabella Jennifer Jessica Josephine Katharina Margaret Mathilde Michelle Nathalie Patricia Penelope Rebecca Stephanie Susanne Valentina Veronica Victoria Yolanda".split(),
    ("latin", "m"): "Alejandro Alexander Benjamin Christopher Dietrich Edouard Fernando Frederick Gregory Guillaume Heinrich Jonathan Joseph Klaus Laurent Lawrence Matthew Maximilian Michael Nicholas Philippe Raphael Ricardo Robert Sebastian Thibault Timothy Vincent Wolfgang Zachary".split(),
    ("cyrillic", "f"): "Анастасия Валентина Виктория Галина Екатерина Елена Ирина Людмила Наталья Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Андрей Владимир Дмитрий Евгений Михаил Николай Павел Сергей Фёдор Юрий Ярослав".split(),
    ("greek", "f"): "Αικατερίνη Αλεξάνδρα Βασιλική Δήμητρα Ελένη Κωνσταντίνα Μαργαρίτα Παναγιώτα".split(),
    ("greek", "m"): "Αθανάσιος Αλέξανδρος Βασίλειος Γεώργιος Δημήτριος Κωνσταντίνος Νικόλαος Παναγιώτης".split(),
}
#: Common given names besides, by script and gender: found, and replaced by one another.
COMMON = {
    ("latin", "f"): "Alice Anna Barbara Carol Clara Diana Emma Eva Hannah Helen Jane Julia Laura Linda Lisa Lucy Maria Marie Martha Mary Nancy Nina Olivia Paula Rachel Rosa Ruth Sandra Sara Sarah Sofia Sophie Susan Teresa".split(),
    ("latin", "m"): "Adam Anton Bob Carlos Charles Daniel David Eric Felix Frank George Hans Henry Jack James Jan John Jose Juan Karl Louis Luis Marco Mark Martin Max Oliver Oscar Otto Paul Peter Pierre Ralph Richard Samuel Simon Stefan Steven Thomas Victor Walter William".split(),
}
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Madame Monsieur Señor Señora Signor Signora".split())
#: Words before a name that isn't in the lists.
CUES = re.compile(r"(?im:\b(?:my name is|full name:|ich heiße|je m'appelle|me llamo|mi chiamo|меня зовут)|^(?:name|signed):) +")
#: Masculine and feminine endings of the surnames of a family.
ENDINGS = (("ов", "ова"), ("ев", "ева"), ("ёв", "ёва"), ("ин", "ина"), ("ский", "ская"), ("цкий", "цкая"), ("ov", "ova"), ("ev", "eva"), ("ski", "ska"), ("cki", "cka"), ("sky", "skaya"), ("ský", "ská"))
#: Endings of given names that tell a gender.
GENDERED = ("ita", "ina", "ella", "a", "o", "а", "я", "ия", "й")
#: Calling codes of one and two digits (ITU-T E.164); all others have three.
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: IPv4 ranges whose addresses stay in them: first octets that are fixed, and the radices and least values of the rest (RFC 1918, 1122, 3927, 5771, 1112).
RANGES = (((10,), (256, 256, 256), (0, 0, 0)), ((192, 168), (256, 256), (0, 0)), ((172,), (16, 256, 256), (16, 0, 0)), ((127,), (256, 256, 256), (0, 0, 0)), ((169, 254), (256, 256), (0, 0)), ((0,), (256, 256, 256), (0, 0, 0)), ((), (16, 256, 256, 256), (224, 0, 0, 0)), ((), (16, 256, 256, 256), (240, 0, 0, 0)))

EMAIL = re.compile(r"(?<![\w.+%-])[^\W_][\w.+%-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?!\w)")
RUN = re.compile(r"[+(]?\d[\d .()+-]*")
NUMBER = re.compile(
    r"(?P<ip>(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)(?!\w))"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\w)|\d{3}(?P<sep>[.-])\d{3}(?P=sep)\d{4}(?![\w-]))"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<account>\d(?:[ -]?\d){12,18}(?!-?\w))"
)
NEXT = re.compile(r"(?<![\w.])[+(]?\d")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SECRET = re.compile(r"(?i)(?<![^\W_])(?:token|secret|password|api[_-]?key)\b[\"']?\s*[:=]\s*[\"']?((?=[\w+/=-]*\d)[A-Za-z0-9+/_=-]{16,})")
CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][^\W\d_]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][^\W\d_]+)?"
NAME = re.compile(rf"(?<!\w)({CAP})\.? (?=({CAP})(?!\w))")
CALLED = re.compile(rf"({CAP})(?!\w)(?: ({CAP})(?!\w))?")


# ---------------------------------------------------------------- permutations


class Permuter:
    """Keyed permutations of digit strings of mixed radix."""

    ROUNDS = 8

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _stream(self, tweak: bytes, rnd: int, other: Sequence[int], n: int) -> list[int]:
        seed = tweak + bytes([0, rnd]) + b",".join(b"%d" % x for x in other)
        data = b"".join(hashlib.blake2b(seed, key=self.key, salt=i.to_bytes(4, "big")).digest() for i in range((n + 7) // 8))
        return [int.from_bytes(data[8 * i : 8 * i + 8], "big") for i in range(n)]

    def _feistel(self, x: list[int], radix: Sequence[int], tweak: bytes, sign: int) -> list[int]:
        h = len(x) // 2
        for rnd in range(self.ROUNDS) if sign > 0 else reversed(range(self.ROUNDS)):
            lo, hi = (0, h) if rnd % 2 else (h, len(x))
            other = x[:lo] + x[hi:]
            add = self._stream(tweak, rnd, other, hi - lo)
            x = x[:lo] + [(v + sign * a) % r for v, a, r in zip(x[lo:hi], add, radix[lo:hi])] + x[hi:]
        return x

    def __call__(self, x: list[int], radix: Sequence[int], kind: str) -> list[int]:
        tweak = f"{kind}|{','.join(map(str, radix))}".encode()
        y = self._feistel(x, radix, tweak, 1)
        for i in reversed(range(len(y))):  # y + 1
            y[i] = (y[i] + 1) % radix[i]
            if y[i]:
                break
        return self._feistel(y, radix, tweak, -1)


def permute_text(p: Permuter, text: str, kind: str, alphabets: Sequence[str]) -> str:
    """Each character of an alphabet becomes one of the same alphabet, in the case it had; all others stay and are part of the format."""
    at, x, radix, shape = [], [], [], []
    for i, c in enumerate(text):
        low = c.lower()
        k = next((k for k, a in enumerate(alphabets) if len(low) == 1 and low in a), None)
        shape.append(low if k is None else chr(0xE000 + k))
        if k is not None:
            at.append((i, k))
            x.append(alphabets[k].index(low))
            radix.append(len(alphabets[k]))
    if not x:
        return text
    out = list(text)
    for (i, k), v in zip(at, p(x, radix, f"{kind}|{''.join(shape)}")):
        c = alphabets[k][v]
        out[i] = c.upper() if text[i] != text[i].lower() and len(c.upper()) == 1 else c
    return "".join(out)


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def refill(text: str, chars: str, of: str) -> str:
    """Puts chars where text has characters of the set `of`."""
    it = iter(chars)
    return "".join(next(it) if c in of else c for c in text)


class Surrogates:
    """Replacement of one entity by type."""

    def __init__(self, key: bytes):
        self.p = Permuter(key)
        lists = {k: [*names, *COMMON.get(k, [])] for k, names in GIVEN.items()}
        self.given = {n: (names, i, k) for k, names in lists.items() for i, n in enumerate(names)}
        self.memo: dict[tuple[str, str], str] = {}

    def __call__(self, kind: str, text: str) -> str:
        if len(self.memo) > 50_000:
            self.memo.clear()
        if (kind, text) not in self.memo:
            self.memo[kind, text] = getattr(self, kind)(text)
        return self.memo[kind, text]

    def email(self, text: str) -> str:
        local, _, domain = text.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{permute_text(self.p, local, 'email', (DIGITS, *LETTERS))}@{permute_text(self.p, host, 'host', (DIGITS, *LETTERS))}.{top}"

    def ip(self, text: str) -> str:
        x = [int(v) for v in text.split(".")]
        k, range_ = range_of(x)
        if range_:
            fixed, radix, least = range_
            rest = self.p([v - low for v, low in zip(x[len(fixed) :], least)], radix, f"ip{k}")
            return ".".join(map(str, [*fixed, *[v + low for v, low in zip(rest, least)]]))
        while True:
            x = self.p(x, [256] * 4, "ip")
            if not range_of(x)[1]:
                return ".".join(map(str, x))

    def phone(self, text: str) -> str:
        """Digits after the calling code are permuted under it and their number, whatever the separators."""
        code = calling_code(text)
        s = "".join(c for c in text if c in DIGITS)
        return refill(text, code + self.digits(s[len(code) :], f"phone{code or '-'}"), DIGITS)

    def digits(self, s: str, kind: str) -> str:
        return "".join(map(str, self.p(list(map(int, s)), [10] * len(s), kind)))

    def ssn(self, text: str) -> str:
        return refill(text, self.digits(text.replace("-", ""), "ssn"), DIGITS)

    def account(self, text: str) -> str:
        """The Luhn remainder, so the validity too, stays."""
        s = "".join(c for c in text if c in DIGITS)
        rest = luhn(s)
        body = self.digits(s[:-1], f"account{rest}")
        return refill(text, body + next(c for c in DIGITS if luhn(body + c) == rest), DIGITS)

    def iban(self, text: str) -> str:
        s = text.replace(" ", "")
        body = permute_text(self.p, s[4:], f"iban{s[:2]}", (DIGITS, LETTERS[0]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + s[:2] + "00")) % 97
        return refill(text, f"{s[:2]}{check:02d}{body}", DIGITS + LETTERS[0].upper())

    def secret(self, text: str) -> str:
        """Hexadecimal letters stay such, so that hexadecimal and other secrets don't meet."""
        return permute_text(self.p, text, "secret", (DIGITS, "abcdef", "ghijklmnopqrstuvwxyz"))

    def first(self, text: str) -> str:
        if text in self.given:
            names, i, k = self.given[text]
            return names[self.p([i], [len(names)], f"given{k}")[0]]
        low = text.lower()
        end = next((e for e in sorted(GENDERED, key=len, reverse=True) if low.endswith(e) and len(e) < len(low)), "")
        return self.stem(text, end, "given", lambda v: v in self.given or any(v.lower().endswith(e) for e in GENDERED if e not in end and len(e) > len(end)))

    def last(self, text: str) -> str:
        end, family = surname_ending(text)
        return self.stem(text, end, f"surname{family}", lambda v: surname_ending(v) != (end, family))

    def stem(self, text: str, end: str, kind: str, foreign: Callable[[str], bool]) -> str:
        """The part before the ending permuted, again where the whole would be read as another format."""
        head, tail = text[: len(text) - len(end)], text[len(text) - len(end) :]
        while True:
            head = permute_text(self.p, head, kind, SOUNDS)
            if not foreign(head + tail) or head + tail == text:
                return head + tail


def surname_ending(text: str) -> tuple[str, int]:
    """The gendered ending of a surname and the number of its family of endings, or none."""
    low = text.lower()
    for k, pair in enumerate(ENDINGS):
        for end in pair:
            if low.endswith(end) and len(low) - len(end) >= 2:
                return end, k
    return "", -1


def range_of(x: Sequence[int]) -> tuple[int, tuple | None]:
    """Number and description of the reserved range of an address."""
    for k, (fixed, radix, least) in enumerate(RANGES):
        rest = x[len(fixed) :]
        if tuple(x[: len(fixed)]) == fixed and all(low <= v < low + r for v, low, r in zip(rest, least, radix)):
            return k, RANGES[k]
    return -1, None


def calling_code(text: str) -> str:
    """Digits of the calling code of a number that begins with +; else none."""
    if not text.startswith("+"):
        return ""
    s = "".join(c for c in text if c in DIGITS)
    return s[:1] if s[:1] in CODES else s[:2] if s[:2] in CODES else s[:3]


# ---------------------------------------------------------------- detection


def numbers(text: str) -> Iterator[tuple[int, int, str]]:
    done = 0
    for run in RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        at = run.start()
        while at < run.end():
            ok = at >= done and not (at and (text[at - 1].isalnum() or text[at - 1] in "_" or (text[at - 1] in ".-" and at > 1 and text[at - 2].isdigit())))
            m = NUMBER.match(text, at) if ok else None
            if m and (m.lastgroup != "ip" or all(int(x) < 256 for x in m[0].split("."))):
                kind = next(k for k in ("ip", "phone", "ssn", "account") if m[k])
                yield m.start(), m.end(), kind
                at = done = m.end()
            else:
                n = NEXT.search(text, at + 1, run.end())
                at = n.start() if n else run.end()


def names(text: str, given: dict) -> Iterator[tuple[int, int, str]]:
    surnames = set()
    for m in NAME.finditer(text):
        if m[1] in given:
            yield m.start(1), m.end(1), "first"
        elif m[1] not in TITLES:
            continue
        if m[2] in given:
            continue
        surnames.add(m[2])
        yield m.start(2), m.end(2), "last"
    for cue in CUES.finditer(text):
        m = CALLED.match(text, cue.end())
        if not m or m[1] in TITLES:
            continue
        yield m.start(1), m.end(1), "first"
        if m[2] and m[2] not in given:
            surnames.add(m[2])
            yield m.start(2), m.end(2), "last"
    if surnames:
        family = {f"{x[: len(x) - len(e)]}{other}" for x in surnames for e, k in [surname_ending(x)] if k >= 0 for other in ENDINGS[k]}
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(surnames | family, key=len, reverse=True)))})(?!\w)", text):
            yield m.start(), m.end(), "last"


def entities(text: str, given: dict) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) in order, without overlaps; at one place the earlier, then the longer span stays."""
    spans: list[tuple[int, int, str]] = []
    if "@" in text:
        spans += [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    if re.search(r"\d", text):
        spans += numbers(text)
        spans += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text) if iban_valid(m[0])]
        if "=" in text or ":" in text:
            spans += [(m.start(1), m.end(1), "secret") for m in SECRET.finditer(text)]
    spans += names(text, given)
    out: list[tuple[int, int, str]] = []
    for s in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def replace(text: str, sur: Surrogates) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, original, surrogate) of each mention."""
    parts, at, found = [], 0, []
    for start, end, kind in entities(text, sur.given):
        new = sur(kind, text[start:end])
        parts += [text[at:start], new]
        found.append((kind, text[start:end], new))
        at = end
    return ("".join([*parts, text[at:]]) if found else text), found


def canonical(kind: str, text: str) -> str:
    """One spelling for variants of an entity."""
    if kind in ("phone", "account", "iban", "ssn"):
        return re.sub(r"[ .()-]", "", text).lower()
    return text if kind == "secret" else text.lower()


def collisions(found: list[tuple[str, str, str]]) -> int:
    """Distinct entities less distinct surrogates, and the other way round."""
    pairs = {(k, canonical(k, a), canonical(k, b)) for k, a, b in found}
    return 2 * len(pairs) - len({(k, a) for k, a, _ in pairs}) - len({(k, b) for k, _, b in pairs})


def _rewrite(batches: Iterator[pa.RecordBatch], at: int, key: bytes) -> Iterator[pa.RecordBatch]:
    sur = Surrogates(key)
    for b in slices(batches):
        texts = [t and replace(t, sur)[0] for t in b.column(at).to_pylist()]
        cols = b.columns
        cols[at] = pa.array(texts, b.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(cols, schema=b.schema)


def pseudonymise(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """docs with the column's personal data replaced; all columns and rows stay."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(column)
    return map_whole(docs, lambda it: _rewrite(it, at, key))


def _report(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    sur = Surrogates(key)
    for b in slices(batches):
        texts, n, kinds, clash = [], [], [], []
        for t in b.column(1).to_pylist():
            new, found = replace(t, sur) if t else (t, [])
            texts.append(new)
            n.append(len(found))
            kinds.append(",".join(f"{k}:{c}" for k, c in sorted(Counter(k for k, _, _ in found).items())))
            clash.append(collisions(found))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(kinds, pa.string()), pa.array(clash, pa.int32())], names=["doc_id", "text", "n_entities", "kinds", "collisions"])


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, number of mentions, mentions by type, collisions."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _report(it, key), "doc_id long, text string, n_entities int, kinds string, collisions int")


def _mentions(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    sur = Surrogates(key)
    for b in slices(batches):
        rows = [(k, canonical(k, x), canonical(k, y)) for t in b.column(0).to_pylist() if t for k, x, y in replace(t, sur)[1]]
        yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.string()) for n, c in zip(("kind", "original", "surrogate"), list(zip(*rows)) or [[]] * 3)})


def collision_report(docs: DataFrame, key: bytes) -> DataFrame:
    """Surrogates that stand for several entities of one type in the corpus, and entities with several surrogates: none, unless a format is at fault. Mentions are combined before the shuffle."""
    m = docs.select(F.col("text").cast("string")).mapInArrow(lambda it: _mentions(it, key), "kind string, original string, surrogate string").distinct()
    met = m.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")
    split = m.groupBy("kind", "original").agg(F.count("*").alias("surrogates")).where("surrogates > 1")
    return met.select("kind", F.col("surrogate").alias("value"), "entities", F.lit(1).cast("long").alias("surrogates")).unionByName(split.select("kind", F.col("original").alias("value"), F.lit(1).cast("long").alias("entities"), "surrogates"))

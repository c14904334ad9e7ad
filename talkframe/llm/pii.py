"""Personal data replaced by keyed surrogates of the same kind, gender, script and format.

Detected: mail addresses, phone numbers, IPv4 addresses, payment cards, IBANs, and person names (a title or a known given name
before capitalised words, then every further mention of those names in the text).

A surrogate is a keyed permutation of the entity's canonical form within its own format class (same length and character classes):
``unmix(mix(x) + 1)`` over the class, where ``mix`` is a Feistel network on its index. The permutation is one cycle, so no entity keeps
its value, two entities never share a surrogate, and an entity has the same surrogate in every document and every spelling - without
any table of what was seen. Issuer digits, country codes, punctuation, capitals and check digits are kept or recomputed. Given
names are permuted within the pool of their script and gender; surnames letter class by letter class, gendered endings kept.

What a permutation cannot exclude is a surrogate that is the real value of another entity in the corpus. ``anonymise`` finds such cases
over all distinct entities of the corpus and moves only those entities on, each along an order of its own through its whole class,
until its value is neither real nor taken; a class without such a value left is widened by a character (private addresses: by the next
range). The moved entities are a table, joined to the texts that hold them, so neither their number nor the corpus has a limit.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talkframe.llm.common import fresh, numbered, settle

KINDS = ("email", "iban", "card", "ip", "phone", "name")
ROUND_VALUES = 4_000_000  # values tried together while entities are moved on; sets the pace only

# --- fixed values: given names by script and gender, titles by gender, letters by class -------------------------
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sophie Emma Clara Marie Camille Lucia Carmen Elena Ingrid Heike Sabine Katrin Isabel Pilar "
                    "Margaret Susan Linda Karen Emily Alice".split(),
    ("latin", "m"): "John Michael David James Robert William Thomas Peter Hans Jürgen Klaus Stefan Pierre Jacques Luc Antoine Carlos "
                    "Javier Miguel Pedro Paul Daniel Martin Andreas".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Владимир Павел Виктор".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Παναγιώτης Γιάννης".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Госпожа Κυρία".split(),
    "m": "Mr Herr Monsieur Señor Sr Don Господин Κύριος".split(),
    "": "Dr Prof".split(),
}
CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "äöü", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
]
ENDINGS = [("ова", "f"), ("ева", "f"), ("ина", "f"), ("ая", "f"), ("ов", "m"), ("ев", "m"), ("ин", "m"), ("ий", "m"), ("ός", "m"), ("ή", "f")]
PADS = [("а", "ё", "б"), ("ά", "ώ", "β")]  # first letters of a script, and the letter its surnames are widened by
IP_CLASSES = [(10 << 24, 1 << 24), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16)]
# -----------------------------------------------------------------------------------------------------------------
_CLASS_OF = {c: (letters, i) for letters in CLASSES for i, c in enumerate(letters)}
_POOL_OF = {n: (script, gender) for (script, gender), names in GIVEN.items() for n in names}
_POOL = sorted({n.lower() for n in _POOL_OF})


def _class_of(c: str) -> tuple[str, int] | None:
    """The letters a character is permuted in and its place there; digits of any script stay in that script."""
    if c not in _CLASS_OF:
        digit = unicodedata.decimal(c, None)
        return None if digit is None else ("".join(chr(ord(c) - digit + i) for i in range(10)), digit)
    return _CLASS_OF[c]


EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
CARD = re.compile(r"(?<![\w.+-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w])|(?<![\w.+-])3\d{3}[ -]?\d{6}[ -]?\d{5}(?![\w])")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)")
PHONE = re.compile(r"(?<![\w+.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w])")
_UPPER = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω]"
_NAME = rf"{_UPPER}[^\W\d_]+(?:-{_UPPER}[^\W\d_]+)?"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_KNOWN = "|".join(n for ns in GIVEN.values() for n in ns)
NAME = re.compile(rf"\b(?:({_TITLE})\.? (?=({_NAME}(?: {_NAME})?))|(?=((?:{_KNOWN}) {_NAME})))")


class Permutation:
    """A keyed one-cycle permutation of range(n)."""

    def __init__(self, key: bytes, label: str, n: int):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.key = hashlib.blake2b(f"{label}:{n}".encode(), key=key, digest_size=32).digest()
        self.mask = (1 << self.half) - 1

    def _f(self, turn: int, x: int) -> int:
        size = (self.half + 7) // 8
        raw = hashlib.shake_128(self.key + bytes([turn]) + x.to_bytes(size, "big")).digest(size)
        return int.from_bytes(raw, "big") & self.mask

    def _mix(self, x: int, turns: range) -> int:
        while True:  # walk until the value is in range again
            a, b = x >> self.half, x & self.mask
            for t in turns:
                if turns.step > 0:
                    a, b = b, a ^ self._f(t, b)
                else:
                    a, b = b ^ self._f(t, a), a
            x = a << self.half | b
            if x < self.n:
                return x

    def __call__(self, x: int, step: int = 0) -> int:
        """The value after ``x`` on the cycle; ``step`` 1 to n - 1 are all others, in an order of x's own."""
        if self.n < 2:
            return x
        ahead = 1 + step * self._stride(x) if step else 1
        return self._mix((self._mix(x, range(6)) + ahead) % self.n, range(5, -1, -1))

    def _stride(self, x: int) -> int:
        raw = hashlib.blake2b(str(x).encode(), key=self.key, digest_size=64).digest()
        stride = 1 + int.from_bytes(raw, "big") % (self.n - 1)
        while math.gcd(stride, self.n) > 1:
            stride = stride % (self.n - 1) + 1
        return stride


class Surrogates:
    """Canonical entity -> canonical surrogate for one key."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.held: dict[tuple, Permutation] = {}

    def _permute(self, label: str, n: int, x: int, step: int = 0) -> int:
        at = (label, n)
        if at not in self.held:
            if len(self.held) > 10_000:
                self.held.clear()
            self.held[at] = Permutation(self.key, label, n)
        return self.held[at](x, step)

    def shape(self, label: str, text: str, free: slice = slice(None)) -> str:
        """Permute the characters of ``text[free]`` within their classes; other characters stay."""
        return self._shape(label, text, free)[0]

    def _shape(self, label: str, text: str, free: slice = slice(None), step: int = 0) -> tuple[str, int]:
        """The permuted text and the size of its class."""
        chars = list(text)
        at = {i: c for i in range(*free.indices(len(chars))) if (c := _class_of(chars[i]))}
        n, x = 1, 0
        for letters, digit in at.values():
            n, x = n * len(letters), x * len(letters) + digit
        x = self._permute(f"{label}:{''.join(letters[0] for letters, _ in at.values())}", n, x, step)
        for i in reversed(at):
            letters = at[i][0]
            x, digit = divmod(x, len(letters))
            chars[i] = letters[digit]
        return "".join(chars), n

    def other(self, kind: str, canon: str, level: int, step: int) -> tuple[str | None, int]:
        """Value ``step`` (from 0) of the class ``level`` characters wider than the entity's own, None if it is not admissible, and how
        many values the class has."""
        if kind == "email":
            local, _, host = canon.partition("@")
            new, n = self._shape("local", local + "b" * level, step=step)
            return f"{new}@{self._host(host)}", n
        if kind == "phone":
            code, _, rest = canon.rpartition(":")
            new, n = self._shape("phone", rest + "0" * level, step=step)
            return f"{code}:{new}", n
        if kind == "card" and luhn(canon):
            body, n = self._shape("card", canon[:-1] + "0" * level, slice(1, None), step)
            return _checked(body), n
        if kind == "card":
            new, n = self._shape("number", canon + "0" * level, slice(1, None), step)
            return (None if luhn(new) else new), n
        if kind == "iban":
            new, n = self._shape("iban", canon[4:].lower() + "0" * level, step=step)
            return _iban(canon[:2], new.upper()), n
        if kind == "name":
            stem = _stem(canon)
            pad = next((p for first, last, p in PADS if first <= canon[:1] <= last), "b")
            new, n = self._shape("surname", canon[:stem] + pad * level, step=step)
            new += canon[stem:]
            return (None if new in _POOL else new), n
        x = _ip_number(canon)
        own = next((i for i, (base, n) in enumerate(IP_CLASSES) if base <= x < base + n), None)
        ranges = [] if own is None else [own, *sorted((i for i in range(len(IP_CLASSES)) if i != own), key=lambda i: IP_CLASSES[i][1])]
        if level < len(ranges):
            base, n = IP_CLASSES[ranges[level]]
            return _ip(base + self._permute(f"ip{base}", n, x % n, step)), n
        if level > len(ranges):
            raise RuntimeError("more than half of all IPv4 addresses are in the texts")
        x = self._permute("ip", 1 << 32, x, step)
        return (_ip(x) if _public(x) else None), 1 << 32

    def _host(self, host: str) -> str:
        labels = host.split(".")
        return ".".join([*(self.shape("label", x) for x in labels[:-1]), labels[-1]])

    def email(self, canon: str) -> str:
        local, _, host = canon.partition("@")
        return f"{self.shape('local', local)}@{self._host(host)}"

    def phone(self, canon: str) -> str:
        code, _, rest = canon.rpartition(":")
        return f"{code}:{self.shape('phone', rest)}"

    def ip(self, canon: str) -> str:
        x = _ip_number(canon)
        for base, n in IP_CLASSES:
            if base <= x < base + n:
                x = base + self._permute(f"ip{base}", n, x - base)
                break
        else:
            while True:
                x = self._permute("ip", 1 << 32, x)
                if _public(x):
                    break
        return _ip(x)

    def card(self, canon: str) -> str:
        if luhn(canon):
            return _checked(self.shape("card", canon[:-1], slice(1, None)))
        while True:
            canon = self.shape("number", canon, slice(1, None))
            if not luhn(canon):
                return canon

    def iban(self, canon: str) -> str:
        return _iban(canon[:2], self.shape("iban", canon[4:].lower()).upper())

    def name(self, canon: str) -> str:
        title = canon[:1].upper() + canon[1:]
        pool = _POOL_OF.get(title)
        if pool:
            names = GIVEN[pool]
            return names[self._permute(f"given:{pool}", len(names), names.index(title))].lower()
        stem = _stem(canon)
        return self.shape("surname", canon[:stem]) + canon[stem:]


def _stem(canon: str) -> int:
    return next((len(canon) - len(e) for e, _ in ENDINGS if canon.endswith(e) and len(canon) > len(e) + 2), len(canon))


def _ip_number(canon: str) -> int:
    a, b, c, d = map(int, canon.split("."))
    return a << 24 | b << 16 | c << 8 | d


def _ip(x: int) -> str:
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _public(x: int) -> bool:
    return 1 <= x >> 24 < 224 and x >> 24 != 127 and not any(base <= x < base + n for base, n in IP_CLASSES)


def _checked(body: str) -> str:
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def _iban(country: str, body: str) -> str:
    return f"{country}{98 - int(_iban_number(body + country + '00')) % 97:02d}{body}"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _iban_number(text: str) -> str:
    return "".join(str(int(c, 36)) for c in text)


def _in_form(form: str, canon: str) -> str:
    """Letters and digits of ``canon`` in the punctuation and capitals of ``form``."""
    fill = iter(canon)
    out = []
    for c in form:
        if c.isalnum():
            x = next(fill)
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join([*out, *fill])


def _cased(form: str, canon: str) -> str:
    if form.isupper() and len(form) > 1:
        return canon.upper()
    return "-".join(p[:1].upper() + p[1:] for p in canon.split("-")) if form[:1].isupper() else canon


def find(text: str, names: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form), ordered and without overlaps; kinds earlier in KINDS win."""
    taken: list[tuple[int, int, str, str]] = []

    def add(start: int, end: int, kind: str, canon: str) -> None:
        if not any(s < end and start < e for s, e, _, _ in near(start, end)):
            taken.append((start, end, kind, canon))

    def near(start: int, end: int) -> list[tuple[int, int, str, str]]:
        return taken if len(taken) < 64 else [x for x in taken if x[0] < end and start < x[1]]

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email", m[0].lower())
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and int(_iban_number(plain[4:] + plain[:4])) % 97 == 1:
            add(*m.span(), "iban", plain)
    for m in CARD.finditer(text):
        plain = re.sub("[ -]", "", m[0])
        if 13 <= len(plain) <= 19:
            add(*m.span(), "card", plain)
    for m in IP.finditer(text):
        if not m[0].startswith(("0.", "127.")):
            add(*m.span(), "ip", m[0])
    for m in PHONE.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        if 7 <= len(digits) <= 15:
            code = re.match(r"\+\d{1,3}(?=[ .(-])", m[0])
            code = code[0][1:] if code else ""
            add(*m.span(), "phone", f"{code}:{digits[len(code):]}")
    if names:
        seen: set[str] = set()
        for m in NAME.finditer(text):
            parts = re.split(r"[ -]", m[2] or m[3])
            seen.update(parts, map(str.upper, parts))
        if seen:
            for m in re.finditer(rf"\b(?:{'|'.join(sorted(map(re.escape, seen), key=lambda x: (-len(x), x)))})\b", text):
                add(*m.span(), "name", m[0].lower())
    return sorted(taken)


def replace(text: str, made: Surrogates, names: bool = True, moved: dict | None = None) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates and the entities found in the original. ``moved`` has the surrogates of moved (kind, canon)."""
    out, at = [], 0
    found = find(text, names)
    for start, end, kind, canon in found:
        form, new = text[start:end], (moved or {}).get((kind, canon)) or getattr(made, kind)(canon)
        if kind == "name":
            new = _cased(form, new)
        elif kind == "email":
            new = "".join(n.upper() if f.isupper() else n for f, n in zip(form, new)) + new[len(form):]
        elif kind == "phone":
            new = _in_form(form, new.replace(":", ""))
        elif kind in ("card", "iban"):
            new = _in_form(form, new)
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), found


#: What every match of NAME holds, without its word borders, for Arrow's regular expressions
_NAME_GATE = rf"(?:(?:{_TITLE})\.?|{_KNOWN}) {_UPPER}"


@cache
def _mark_gate() -> str:
    """An @ or a digit of any script, as ``\\d`` has them here."""
    first = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.decimal(c, None) == 0]
    return f"[@{''.join(f'{c}-{chr(ord(c) + 9)}' for c in first)}]"


def _flags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can hold an entity at all, and those that can hold a title or given name before a capital: never fewer than do."""
    marks, names = (pc.match_substring_regex(texts, p).fill_null(False).to_numpy(zero_copy_only=False) for p in (_mark_gate(), _NAME_GATE))
    return marks | names, names


def entities(docs: DataFrame) -> DataFrame:
    """Distinct-ready rows (kind, canon) of every entity of the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, str]] = set()
            for text, _, names in _candidates(batch):
                if text is not None:
                    found.update((k, c) for _, _, k, c in find(text, names))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.string())], names=["kind", "canon"])

    return docs.select("text").mapInArrow(run, "kind string, canon string")


def _candidates(batch: pa.RecordBatch) -> Iterator[tuple[str | None, int, bool]]:
    """(text, row, whether names are possible) of each row; text is None where nothing can be found."""
    texts = batch.column("text")
    some, names = _flags(texts)
    for r in range(batch.num_rows):
        yield (texts[r].as_py() if some[r] else None), r, bool(names[r])


def surrogates_of(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of distinct entities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for b in batches:
            new = [getattr(made, k)(c) for k, c in zip(b.column("kind").to_pylist(), b.column("canon").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("canon"), pa.array(new, pa.string())], names=["kind", "canon", "surrogate"])

    return found.mapInArrow(run, "kind string, canon string, surrogate string")


def _own(mapped: DataFrame) -> DataFrame:
    """Entities whose surrogate must not be real. Given names come from a public pool and don't count."""
    return mapped.filter(~((F.col("kind") == "name") & F.col("canon").isin(_POOL)))


def collisions(mapped: DataFrame) -> int:
    """Surrogates shared by two entities, or equal to the real value of an entity."""
    return _claims(_own(mapped)).count()


def _claims(own: DataFrame) -> DataFrame:
    """(kind, value, keeper) of surrogates that can't stay with all their entities; ``keeper`` may, null if the value is real."""
    pool = (F.col("kind") == "name") & F.col("value").isin(_POOL)
    sides = own.select("kind", F.col("surrogate").alias("value"), F.col("canon").alias("keeper"), F.lit(0).alias("c")).union(
        own.select("kind", F.col("canon").alias("value"), F.lit(None).cast("string").alias("keeper"), F.lit(1).alias("c")))
    values = sides.groupBy("kind", "value").agg(F.min("keeper").alias("keeper"), F.count("keeper").alias("s"), F.max("c").alias("c"))
    values = values.withColumn("real", (F.col("c") > 0) | pool).filter("s > 1 or (s > 0 and real)")
    return values.select("kind", "value", F.when(~F.col("real"), F.col("keeper")).alias("keeper"))


def _tried(waiting: DataFrame, key: str, window: int) -> DataFrame:
    """The next ``window`` values of each waiting entity (null where not admissible), with the level and step to go on from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for b in batches:
            for low in range(0, b.num_rows, max(1, 10_000 // window)):
                rows = []
                for x in b.slice(low, max(1, 10_000 // window)).to_pylist():
                    kind, canon, level, step = x["kind"], x["canon"], x["level"], x["step"]
                    for _ in range(window):
                        value, n = made.other(kind, canon, level, step)
                        level, step = (level, step + 1) if step + 1 < n else (level + 1, 0)
                        rows.append((kind, canon, level, step, value))
                types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["kind", "canon", "level", "step", "value"])

    return waiting.select("kind", "canon", "level", "step").mapInArrow(run, "kind string, canon string, level long, step long, value string")


def moved_on(mapped: DataFrame, key: str) -> DataFrame | None:
    """(kind, canon, surrogate) of the entities that can't keep the surrogate of ``mapped`` (distinct entities, settled); None if all can.

    Every round each waiting entity takes its first value that is neither real nor taken; of several at one value one gets it. Values
    are tried in an order of the entity's own through its whole class, so it is found if there is one, else the class is widened.
    """
    own = _own(mapped)
    claims = settle(_claims(own), "claims")
    if claims.isEmpty():
        return None
    meets = (own["kind"] == claims["kind"]) & (own["surrogate"] == claims["value"])
    waiting = own.join(claims, meets).filter(~F.col("canon").eqNullSafe(F.col("keeper"))).select(
        own["kind"], "canon", F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("step"))
    waiting, window, moved = settle(waiting, "waiting"), 4, None
    taken = own.select("kind", F.explode(F.array("canon", "surrogate")).alias("value"))
    while n := waiting.count():
        window = max(1, min(window, ROUND_VALUES // n))
        tried = settle(_tried(waiting, key, window), "tried")
        gone = taken if moved is None else taken.union(moved.select("kind", F.col("surrogate").alias("value")))
        free = tried.filter("value is not null").join(gone, ["kind", "value"], "left_anti")
        first = settle(free.groupBy("kind", "canon").agg(F.min(F.struct("level", "step", "value")).alias("p")).select("kind", "canon", "p.*"), "picks")
        won = first.groupBy("kind", "value").agg(F.min("canon").alias("canon")).select("kind", "canon", F.col("value").alias("surrogate"))
        moved = settle(won if moved is None else moved.unionByName(won), "moved")
        last = tried.groupBy("kind", "canon").agg(F.max(F.struct("level", "step")).alias("last"))
        on = last.join(first, ["kind", "canon"], "left").join(moved, ["kind", "canon"], "left_anti")
        waiting = settle(on.select("kind", "canon", F.coalesce("level", "last.level").alias("level"), F.coalesce("step", "last.step").alias("step")), "waiting")
        window *= 2
    return moved


def _with_moved(docs: DataFrame, moved: DataFrame) -> DataFrame:
    """``docs`` and, as last column, those (kind, canon, surrogate) of ``moved`` that the text holds. Texts meet by hash; one more entry
    for a text with an equal hash changes nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = batch.column("_text").to_pylist(), set()
            for text, r, names in _candidates(batch):
                if text is not None:
                    rows.update((at[r], k, c) for _, _, k, c in find(text, names))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], names=["_text", "kind", "canon"])

    held = docs.select(F.xxhash64("text").alias("_text"), "text").mapInArrow(run, "_text long, kind string, canon string")
    lists = held.join(moved, ["kind", "canon"]).distinct().groupBy("_text").agg(F.collect_list(F.struct("kind", "canon", "surrogate")).alias("_moved"))
    # settled, so that its size is known when the join is planned; named as no column of ``docs`` is
    at, last = fresh(docs, "_text"), fresh(docs, "_moved")
    lists = settle(lists, "moved_texts").select(F.col("_text").alias(at), F.col("_moved").alias(last))
    return docs.withColumn(at, F.xxhash64("text")).join(lists, at, "left").drop(at)


def anonymise(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with ``text`` replaced, plus ``_entities``: (kind, start, end in the original) of each replacement.

    Null and empty texts stay as they are; texts without personal data are returned unchanged. Rows are independent, so repeated
    rows get equal results. An existing ``_entities`` column is replaced. Runs jobs while it is built.
    """
    chosen = f"{key}/0"
    moved = moved_on(settle(surrogates_of(entities(docs).distinct(), chosen), "entities"), chosen)
    docs = docs.drop("_entities")
    schema = docs.schema
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    at = schema.names.index("text")
    moves = moved is not None
    docs = numbered(docs, "text")
    if moves:
        docs = _with_moved(docs, moved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(chosen)
        for batch in batches:
            known = batch.column("text").is_valid().to_numpy(zero_copy_only=False)
            old = batch.column("text")
            new: dict[int, str] = {}
            lists: list[list] = [[]] * batch.num_rows
            for text, r, names in _candidates(batch):
                if text is not None and known[r]:
                    own = batch.column(batch.num_columns - 1)[r].as_py() if moves else None
                    changed, hits = replace(text, made, names, {(m["kind"], m["canon"]): m["surrogate"] for m in own or ()})
                    if hits:
                        new[r] = changed
                        lists[r] = [{"kind": k, "start": s, "end": e} for s, e, k, _ in hits]
            texts = old
            if new:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(new)] = True
                texts = pc.replace_with_mask(old, pa.array(mask), pa.array([new[r] for r in sorted(new)], old.type))
            cols = [texts if i == at else c for i, c in enumerate(batch.columns[:len(schema)])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lists, spans)], names=[*schema.names, "_entities"])

    made = StructType.fromDDL("_entities array<struct<kind:string,start:int,end:int>>")
    return docs.mapInArrow(run, StructType([*schema.fields, *made.fields]))

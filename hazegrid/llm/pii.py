"""Personal data replaced by surrogates of the same kind.

Detected: e-mail addresses, phone numbers, payment cards (with a valid check digit), social security
numbers, IPv4 addresses, and names behind a title: all capitalised words, initials and particles. A surrogate is drawn from a keyed hash (HMAC-SHA256)
of type, canonical value and attempt, so an entity gets the same surrogate in every document and
spelling, and nobody without the key can redo it. Kept are: separators, lengths, letter case, digits as
digits and letters as letters of their script; top-level domain; country code; the card's
network digit and a valid check digit; private or public address range; a name's gender (from its
title) and script. Mail domains and surnames are drawn by themselves, so shared ones stay shared.

Distinctness is checked over the whole corpus: a surrogate that two entities drew, or that is a
real entity, is drawn anew (all but the smallest holder of a shared one) until none is left; after ``ROUNDS``
draws from pools that grow: longer local parts, phone numbers and surnames, and for private addresses
the range 10.x, then public ones. Cards and social security numbers keep their pools (over 10^8). The
few later draws reach the texts by a join on the text's digest.

Defined results: null text stays null with no entities; of overlapping hits the first, then the
longest counts; every row is returned, other columns are not read.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import in_batches, join_measured, stored

KEY = b"set your own key"
ROUNDS = 50  # draws that keep the length
WIDE = 50  # draws from this number on come from pools that grow with each

# titles and the gender they tell
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Господин": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Госпожа": "f",
          "Dr": "n", "Prof": "n"}
# surrogate names by script and gender
GIVEN = {("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Lucas Martin Oscar Paul Simon Thomas Victor".split(),
         ("latin", "f"): "Anna Bella Clara Diana Emma Flora Helena Irene Julia Laura Maria Nora Olivia Petra Sonia Vera".split(),
         ("latin", "n"): "Alex Andrea Charlie Dominique Jo Kim Lou Maxime Nikita Robin Sacha Sam Toni Vanja".split(),
         ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Никита Олег Павел".split(),
         ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Ирина Мария Нина Ольга Полина Софья".split(),
         ("cyrillic", "n"): "Саша Женя Валя Слава".split()}
SURNAMES = {"latin": "Adler Bauer Costa Duval Engel Fabre Garcia Hansen Iversen Jansen Keller Lopez Moreau Novak Olsen Perez Quint Rossi Silva Torres Urban Vidal Weber Zeller".split(),
            "cyrillic": "Белых Черных Долгих Седых Коваленко Шевченко Бондаренко Ткаченко Живаго Дурново".split()}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

# a whole word of any script, with apostrophes and hyphens inside, or an initial with its dot
_LETTERS = r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*"
_WORD = re.compile(rf"[^\W\d_]\.(?=[ \xa0]?[^\W\d_])|{_LETTERS}(?:['\u2019\u02bc-]{_LETTERS})*")
_PARTICLES = frozenset("af al av ap bin bint ben da das de del della dei den der des di do dos du e el ibn la las le les lo los san ter ten van vom von y zu zum zur".split())
_TITLES = TITLES | {t.upper(): g for t, g in TITLES.items()}
_TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(_TITLES, key=len, reverse=True))})\b\.?[ \xa0](?=[^\W\d_])")
_LOCAL = re.compile(r"[\w+%-](?:[\w.+%-]*[\w+%-])?$")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMBERS = (
    ("ip", re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)", re.ASCII)),
    ("ssn", re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])", re.ASCII)),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|-\d)", re.ASCII)),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|-\d)", re.ASCII)),
)
_DIGIT = re.compile(r"[0-9]")


def luhn_rest(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10


def script_of(word: str) -> str:
    c = next((x for x in word if x.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _name_end(text: str, at: int) -> int:
    """End of the name that starts at ``at``: capitalised words, initials, and particles before such a word; ``at`` if none."""
    end = at
    while m := _WORD.match(text, at):
        bare = m[0][2:] if m[0][1:2] in ("'", "\u2019", "\u02bc") else m[0]  # d'Artagnan
        if m[0][0].isupper() or bare[0].isupper() or not m[0][0].islower():  # or a script without case
            end = m.end()
        elif m[0].casefold() not in _PARTICLES:
            break
        at = m.end()
        if text[at:at + 1] in (" ", "\xa0"):
            at += 1
        elif not m[0].endswith("."):
            break
    return end


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value), in order, without overlaps. For names the type holds gender and script."""
    hits = []
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text[max(0, at - 64):at]), _DOMAIN.match(text, at + 1, at + 256)
        if local and domain:
            value = local[0].lower() + "@" + domain[0].lower()
            hits.append((at - len(local[0]), domain.end(), "email", value))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for kind, pattern in _NUMBERS:
            for m in pattern.finditer(text):
                digits = "".join(c for c in m[0] if c.isdigit())
                if kind == "card" and luhn_rest(digits):
                    continue
                value = m[0] if kind == "ip" else digits
                hits.append((m.start(), m.end(), kind, ("+" if m[0][0] == "+" else "") + value))
    for m in _TITLED.finditer(text):
        end = _name_end(text, m.end())
        name = text[m.end():end]
        if name and (not m[1].isupper() or name.isupper()):
            hits.append((m.end(), end, f"name/{_TITLES[m[1]]}/{script_of(name)}", " ".join(name.casefold().split())))
    hits.sort(key=lambda h: (h[0], -h[1]))
    out, end = [], 0
    for h in hits:
        if h[0] >= end:
            out.append(h)
            end = h[1]
    return out


class _Draws:
    """A stream of keyed random numbers for one entity."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.seed, self.n, self.pool = key, "\x1f".join(what).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def digits(self, like: str) -> str:
        """Zero stays possible only where it was, so that lengths and ranges keep their look."""
        return "".join(str(self.below(10)) if c == "0" else str(1 + self.below(9)) for c in like)

    def shape(self, like: str) -> str:
        out = []
        for c in like:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                alphabet = ALPHABETS[script_of(c)]
                out.append(alphabet[self.below(len(alphabet))])
            else:
                out.append(c)
        return "".join(out)


def _country(digits: str) -> int:
    """Length of the country code behind a plus: one digit in zones 1 and 7, else two."""
    return 1 if digits[:1] in "17" else 2


def surrogate(kind: str, value: str, attempt: int, key: bytes = KEY) -> str:
    """Canonical surrogate of a canonical value."""
    d = _Draws(key, kind, value, str(attempt))
    wide = max(0, attempt - WIDE + 1)
    if kind == "email":
        local, _, domain = value.partition("@")
        names, _, top = domain.rpartition(".")
        return d.shape(local + "a" * wide) + "@" + _Draws(key, "domain", domain).shape(names) + "." + top
    if kind == "phone":
        plus, digits = value[:1] == "+", value.lstrip("+")
        n = _country(digits) if plus else 0
        return ("+" if plus else "") + digits[:n] + d.digits(digits[n:] + "0" * wide)
    if kind == "card":
        body = value[0] + d.digits("0" * (len(value) - 2))
        return body + str(-luhn_rest(body + "0") % 10)
    if kind == "ssn":
        return f"{1 + d.below(665):03d}{1 + d.below(99):02d}{1 + d.below(9999):04d}"
    if kind == "ip":
        parts = value.split(".")
        fixed = 1 if parts[0] in ("10", "127") else 2 if parts[:2] == ["192", "168"] or parts[0] == "172" and 16 <= int(parts[1]) < 32 else 0
        if fixed and wide:  # the largest private range, and if that is full too, any public address
            fixed, parts = (1, ["10", "0", "0", "0"]) if wide <= WIDE else (0, parts)
        if fixed:
            return ".".join(parts[:fixed] + [str(d.below(256) if wide else 1 + d.below(254)) for _ in parts[fixed:]])
        first = [x for x in range(1, 224) if x not in (10, 127, 172, 192)]
        return ".".join([str(first[d.below(len(first))])] + [str(1 + d.below(254)) for _ in range(3)])
    _, gender, script = kind.split("/")
    pool = "cyrillic" if script == "cyrillic" else "latin"
    words = value.split(" ")
    last = _Draws(key, "surname", words[-1], str(attempt))
    surname = SURNAMES[pool][last.below(len(SURNAMES[pool]))]
    # the pool is finite: a second, drawn part keeps many surnames apart
    surname += "-" + "".join(ALPHABETS[pool][last.below(len(ALPHABETS[pool]))] for _ in range(3 + wide)).capitalize() if attempt else ""
    given = _Draws(key, "given", kind, words[0], str(attempt))
    names = GIVEN[pool, gender]
    return (f"{names[given.below(len(names))]} {surname}" if len(words) > 1 else surname).casefold()


def _email_written(original: str, value: str) -> str:
    """A surrogate's local part may be longer."""
    local, longer = original.index("@"), value.index("@") - original.index("@")
    like = original[:local] + original[local - 1] * longer + original[local:]
    return "".join(v.upper() if o.isupper() else v for o, v in zip(like, value))


def written(kind: str, original: str, value: str) -> str:
    """The canonical surrogate in the original's spelling: separators, case."""
    if kind.startswith("name"):
        out = " ".join("-".join(p[:1].upper() + p[1:] for p in w.split("-")) for w in value.split(" "))
        return out.upper() if original.isupper() else out
    if kind == "ip":
        return value
    if kind == "email":
        return _email_written(original, value)
    digits = iter(value.lstrip("+"))
    return "".join(next(digits) if c.isdigit() else c for c in original) + "".join(digits)


def _entities(rows: DataFrame) -> DataFrame:
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for digest, text in zip(b.column("digest").to_pylist(), b.column("text").to_pylist()):
            out += [(digest, kind, value) for kind, value in {(h[2], h[3]) for h in detect(text or "")}]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.string(), pa.string()))], ["digest", "kind", "value"])

    return rows.mapInArrow(in_batches(one), "digest binary, kind string, value string")


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        drawn = [surrogate(*x, key=key) for x in zip(*(b.column(c).to_pylist() for c in ("kind", "value", "attempt")))]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(drawn, pa.string())], [*b.schema.names, "drawn"])

    return rows.mapInArrow(in_batches(one), "kind string, value string, attempt int, drawn string")


def _family(kind: str) -> Column:
    """Names of all genders and scripts must stay apart from each other."""
    return F.substring_index(kind, "/", 1)


def distinct_surrogates(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, value) -> kind, value, attempt, drawn: no two values of a type share ``drawn``, and no
    ``drawn`` is a value."""
    now = stored(_drawn(entities.select("kind", "value").distinct().withColumn("attempt", F.lit(0)), key), "drawn")
    real = now.select(_family("kind").alias("_rk"), F.col("value").alias("_rv")).distinct()
    for turn in range(ROUNDS + 2 * WIDE):
        tagged = now.withColumn("_f", _family("kind"))
        holder = tagged.groupBy(F.col("_f").alias("_hf"), F.col("drawn").alias("_hd")).agg(
            F.min(F.struct("kind", "value")).alias("_first"), F.count(F.lit(1)).alias("_n"))
        seen = tagged.join(holder, (F.col("_f") == F.col("_hf")) & (F.col("drawn") == F.col("_hd")))
        seen = seen.join(real, (F.col("_f") == F.col("_rk")) & (F.col("drawn") == F.col("_rv")), "left")
        again = F.col("_rv").isNotNull() | ((F.col("_n") > 1) & (F.struct("kind", "value") != F.col("_first")))
        judged = stored(seen.select("kind", "value", "attempt", "drawn", again.alias("again")), "judged")
        if judged.where("again").isEmpty():
            return judged.drop("again")
        # a pool may be full: what still collides after ROUNDS goes on to pools that grow with each draw
        following = F.col("attempt") + 1 if turn + 1 < ROUNDS else F.greatest(F.col("attempt") + 1, F.lit(WIDE))
        new = _drawn(judged.where("again").select("kind", "value", following.cast("int").alias("attempt")), key)
        now = stored(judged.where("NOT again").drop("again").unionByName(new), "drawn")
    raise RuntimeError(f"surrogates still collide after {ROUNDS + 2 * WIDE} draws")


def replace_pii(docs: DataFrame, key: bytes = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities (replaced mentions) for every row."""
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), digest.alias("digest"))
    found = stored(_entities(rows.select("digest", "text")), "entities")
    later = distinct_surrogates(found, key).where("attempt > 0").select(F.col("kind").alias("_k"), F.col("value").alias("_v"), "attempt")
    later = stored(later, "later")
    needs = join_measured(found.distinct(), later, [("kind", "_k"), ("value", "_v")], "inner")
    entry = F.struct("kind", "value", "attempt")
    needs = stored(needs.groupBy(F.col("digest").alias("_d")).agg(F.collect_list(entry).alias("later")), "needs")
    ready = join_measured(rows, needs, [("digest", "_d")]).select("doc_id", "text", "later")

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        out, n = [], []
        for t, more in zip(b.column("text").to_pylist(), b.column("later").to_pylist()):
            hits = detect(t) if t else []
            attempts = {(x["kind"], x["value"]): x["attempt"] for x in more or ()}
            parts, at = [], 0
            for start, end, kind, value in hits:
                new = surrogate(kind, value, attempts.get((kind, value), 0), key)
                parts += [t[at:start], written(kind, t[start:end], new)]
                at = end
            out.append("".join(parts) + t[at:] if hits else t)
            n.append(len(hits))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), pa.array(n, pa.int64())], ["doc_id", "text", "n_entities"])

    schema = f"doc_id {ready.schema['doc_id'].dataType.simpleString()}, text string, n_entities long"
    return ready.mapInArrow(in_batches(one), schema)

"""Surrogates for personal data: keyed, of the same kind and format, distinct, and coreferent.

An entity is its kind and a canonical value (digits of a phone number, lower-case
address, one word of a name).  The corpus has one table of distinct entities;
each gets a surrogate drawn from a keyed hash, and those that meet another
surrogate or a real value of the corpus are drawn again.  Every mention of an
entity, in any document and format, then shows the same surrogate.
"""

import hashlib
import hmac
import ipaddress
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted
from plumbline.functions.skew import split_join
from plumbline.llm.common import prefix_for, stored

# The key of a session that sets none: for trials, as everybody can read it.
KEY_SETTING, TRIAL_KEY = "spark.plumbline.surrogateKey", "plumbline"
MOST_ATTEMPTS = 40
_WIDER = 8           # the attempt from which the other private addresses are drawn from too

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![0-9A-Za-z.+-])(?:3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|[2-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7})(?![0-9A-Za-z])")
_IP = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?:(?:\.[0-9]{1,3}){3})?(?![0-9A-Za-z])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_PHONE = re.compile(r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])"
                    r"|(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])")

# Forms of address by the gender they show.
_TITLES = {
    "m": "Mr Mister Sir Herr Herrn Monsieur Señor Sr Don господин г-н κύριος",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Mlle Señora Sra Señorita Srta Doña госпожа г-жа κυρία",
    "n": "Dr Prof Professor Professeur Doktor Doctor Docteur Doctora",
}
_GENDER = {t.lower(): g for g, ts in _TITLES.items() for t in ts.split()}
_NAME_WORD = r"[^\W\d_a-zß-öø-ÿа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"
_NAME = re.compile(r"(?<!\w)(?P<title>(?i:" + "|".join(sorted(map(re.escape, _GENDER), key=len, reverse=True))
                   + r"))\.?\s(?P<name>" + _NAME_WORD + r"(?: " + _NAME_WORD + r"){0,2})")
_CUES = ["y name is ", "ch heiße ", "ein Name ist ", "e m'appelle ", "e llamo ", "i nombre es "]
_CUE = re.compile("(?:" + "|".join(_CUES) + ")"
                  r"(?P<name>" + _NAME_WORD + r"(?: " + _NAME_WORD + r"){0,2})")


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _upper_first(word: str) -> bool:
    return word[0].isupper() and not word[0].islower()


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN")
    return {"CYRILLIC": "c", "GREEK": "g"}.get(name.split()[0], "l")


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, canonical value)`` of the mentions, in order, without overlap."""
    return [m[:4] for m in _found(text)]


def _found(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """Mentions as ``find`` has them, with the gender that the text shows: f, m or n."""
    if not text:
        return []
    found = []
    if "@" in text:
        for m in _EMAIL.finditer(text):
            found.append((m.start(), m.end(), "email", m[0].lower()))
    if re.search("[0-9]|::", text):
        for m in _IBAN.finditer(text):
            value = m[0].replace(" ", "")
            if 15 <= len(value) <= 34 and _iban_rest(value) == 1:
                found.append((m.start(), m.end(), "iban", value))
        for m in _CARD.finditer(text):
            value = _digits(m[0])
            if len(value) == 16 and value[0] != "2" or len(value) <= 19 and luhn(value):
                found.append((m.start(), m.end(), "card", value))
        for m in _IP.finditer(text):
            if all(int(x) < 256 for x in m[0].split(".")):
                found.append((m.start(), m.end(), "ip", ".".join(str(int(x)) for x in m[0].split("."))))
        for m in _IPV6.finditer(text):
            mention = m[0] if m[0].endswith("::") else m[0].rstrip(":")
            try:
                value = str(ipaddress.IPv6Address(mention))
            except ValueError:
                continue
            if value != "::":
                found.append((m.start(), m.start() + len(mention), "ipv6", value))
        for m in _NATIONAL.finditer(text):
            found.append((m.start(), m.end(), "national", _digits(m[0])))
        for m in _PHONE.finditer(text):
            value = _digits(m[0])
            if 9 <= len(value) <= 15:
                found.append((m.start(), m.end(), "phone", value[-10:] if len(value) == 11 and value[0] == "1" else value))
    names: dict[str, tuple[str, str]] = {}      # what a mention can look like: kind and canonical name
    genders: dict[tuple[str, str], str] = {}
    patterns = [_NAME]
    if any(cue in text for cue in _CUES):
        patterns.append(_CUE)
    for pattern in patterns:
        for m in pattern.finditer(text):
            words = []
            for w in m["name"].split(" "):
                if not _upper_first(w):
                    break
                words.append(w)
            gender = _GENDER[m["title"].lower()] if pattern is _NAME else "n"
            if pattern is _NAME and not (_upper_first(m["title"]) or m["title"][0] in "гκ"):
                continue
            for i, w in enumerate(words):
                given = len(words) > 1 and i < len(words) - 1
                value = w[0] + w[1:].lower() if w.isupper() else w
                name = names.setdefault(w, (f"name_{_script(w)}", value))
                genders[name] = min(genders.get(name, "n"), gender if given else "n")   # f, m, n
                if len(w) > 2:
                    names.setdefault(w.upper(), names[w])
    if names:
        any_name = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)")
        for m in any_name.finditer(text):
            found.append((m.start(), m.end(), *names[m[0]]))
    out, last = [], 0
    for start, end, kind, value in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= last:
            out.append((start, end, kind, value, genders.get((kind, value), "n")))
            last = end
    return out


class _Draws:
    """Numbers drawn from a keyed hash of an entity."""

    def __init__(self, key: str, *of):
        self.seed = hmac.new(key.encode(), "\x1f".join(map(str, of)).encode(), hashlib.sha256).digest()
        self.pool, self.block = b"", 0

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x * n >> 32

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))

    def like(self, s: str) -> str:
        return "".join(str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if "a" <= c <= "z"
                       else chr(65 + self.below(26)) if "A" <= c <= "Z" else c for c in s)


# Sounds that names are made of, by script (Latin, Cyrillic, Greek).
_SOUNDS = {"l": ("bdfgklmnprstvz", "aeiou"), "c": ("бвгдзклмнпрст", "аеиоу"), "g": ("βγδκλμνπρστφ", "αειου")}
_ENDINGS = {"f": {"l": "a", "c": "а", "g": "α"}, "m": {"l": "n", "c": "н", "g": "ς"}, "n": {"l": "s", "c": "с", "g": "ν"}}


def draw(kind: str, value: str, attempt: int, key: str, gender: str = "n") -> str:
    """The surrogate, in canonical form, that an entity gets at an attempt; ``gender`` is that of a name."""
    d = _Draws(key, kind, value, attempt)
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        home = _Draws(key, "domain", domain)  # one domain, one surrogate
        return d.like(local) + "@" + ".".join([home.like(x) for x in labels[:-1]] + labels[-1:])
    if kind == "iban":
        body = value[:2] + "00" + d.like(value[4:])
        return body[:2] + f"{98 - _iban_rest(body):02d}" + body[4:]
    if kind == "card":
        kept = 2 if len(value) == 15 else 1     # 15 digits are a card by the first two
        body = value[:kept] + d.digits(len(value) - kept - 1)
        check = next(c for c in "0123456789" if luhn(body + c))
        return body + (check if luhn(value) else str((int(check) + 1 + d.below(9)) % 10))
    if kind == "ip":
        a, b, *_ = map(int, value.split("."))
        rest = [str(1 + d.below(254)) for _ in range(3)]
        if a == 10 or a == 127:
            return ".".join([str(a), *rest])
        if (a, b) == (192, 168) or a == 172 and 16 <= b < 32:
            if attempt >= _WIDER:
                return ".".join(["10", *rest])
            return ".".join([str(a), str(b), *rest[1:]])
        first = 11 + d.below(212)
        return ".".join([str(first + (first in (127, 172, 192))), *rest])
    if kind == "ipv6":
        groups = ipaddress.IPv6Address(value).exploded.split(":")
        return str(ipaddress.IPv6Address(":".join(groups[:1] + [f"{d.below(65536):04x}" for _ in groups[1:]])))
    if kind == "national":
        return str(900 + d.below(100)) + d.digits(6)
    if kind == "phone":
        if len(value) == 10:
            middle = "555" if value[3:6] == "555" else str(2 + d.below(8)) + d.digits(2)
            return str(2 + d.below(8)) + d.digits(2) + middle + d.digits(4)
        return value[:2] + d.digits(len(value) - 2)
    script = kind.partition("_")[2]
    consonants, vowels = _SOUNDS[script]
    size = 2 + d.below(2) + attempt // 4
    name = "".join(consonants[d.below(len(consonants))] + vowels[d.below(len(vowels))] for _ in range(size))
    ending = _ENDINGS[gender][script]
    name = name[:-1] + ending if gender == "f" else name + ending
    return name[0].upper() + name[1:]


def render(kind: str, mention: str, surrogate: str) -> str:
    """The surrogate in the format of a mention."""
    if kind == "email":
        return "".join(s.upper() if m.isupper() else s for m, s in zip(mention, surrogate, strict=True))
    if kind in ("card", "national", "phone"):
        spare = len(_digits(mention)) - len(surrogate)  # a country code stays
        digits = iter(surrogate)
        seen, out = 0, []
        for c in mention:
            if c.isdigit():
                seen += 1
                c = c if seen <= spare else next(digits)
            out.append(c)
        return "".join(out)
    if kind == "iban":
        letters = iter(surrogate)
        return "".join(c if c == " " else next(letters) for c in mention)
    if not kind.startswith("ip") and mention.isupper():
        return surrogate.upper()
    return surrogate


TEXTS_AT_ONCE = 64

_SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("value", T.StringType()), T.StructField("gender", T.StringType())]))


@F.arrow_udf(_SPANS)
def _searched(text: pa.Array) -> pa.Array:
    """The mentions of a text; null for a text without one."""
    found = [_found(t.as_py()) for t in text]
    flat = [m for ms in found for m in ms]
    parts = [pa.array([m[i] for m in flat], kind) for i, kind in enumerate([pa.int32()] * 2 + [pa.string()] * 3)]
    ends = np.cumsum([len(ms) for ms in found], dtype=np.int32)
    begins = pa.array(np.concatenate([[0], ends]).astype(np.int32),
                      mask=np.array([not ms for ms in found] + [False], dtype=bool))
    return pa.ListArray.from_arrays(begins, pa.StructArray.from_arrays(parts, [f.name for f in _SPANS.elementType]))


@F.arrow_udf(T.StringType())
def _replaced(text: pa.Array, spans: pa.Array, entities: pa.Array) -> pa.Array:
    def new(t, found, es):
        known = {(e["kind"], e["value"]): e["surrogate"] for e in es}
        parts, last = [], 0
        for m in found:
            parts += [t[last:m["start"]], render(m["kind"], t[m["start"]:m["end"]], known[m["kind"], m["value"]])]
            last = m["end"]
        return "".join([*parts, t[last:]])

    # a batch holds thousands of texts; only a few at a time are Python objects
    out = [pa.array([new(*row) for row in zip(*(c.slice(a, TEXTS_AT_ONCE).to_pylist() for c in (text, spans, entities)), strict=True)],
                    pa.string()) for a in range(0, len(text), TEXTS_AT_ONCE)]
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def assign(entities: DataFrame, key: str, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """``(kind, value, surrogate)`` for distinct ``(kind, value)``, and the ``gender`` of names where given.

    Names of one script are one kind.  Within a kind no two surrogates are equal and none is a value of the corpus.
    Of entities that draw one surrogate the smallest value keeps it and the others draw again, from a wider space
    after some attempts where the kind has one.  Entities left after ``most_attempts`` are a ``ValueError``: their
    kind has too few values.  No entities give no rows.
    """
    @F.pandas_udf("string")
    def drawn(kind: pd.Series, value: pd.Series, attempt: pd.Series, gender: pd.Series) -> pd.Series:
        return pd.Series([draw(k, v, a, key, g) for k, v, a, g in zip(kind, value, attempt, gender, strict=True)], dtype=object)

    def attempts(df):
        return df.withColumn("surrogate", drawn("kind", "value", "attempt", "gender"))

    entities = stored(entities if "gender" in entities.columns else entities.withColumn("gender", F.lit("n")), "entities")
    table = stored(attempts(entities.withColumn("attempt", F.lit(0))), "surrogates")
    for _ in range(most_attempts):
        first = table.groupBy("kind", "surrogate").agg(F.min("value").alias("first"), F.count("*").alias("n")) \
            .where("n > 1").drop("n")
        real = entities.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        clash = stored(table.join(first, ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left")
                       .where("real or value != first").select("kind", "value", "gender", F.expr("attempt + 1 as attempt")), "clashes")
        if clash.isEmpty():
            return table.select("kind", "value", "surrogate")
        table = stored(table.join(clash.select("kind", "value"), ["kind", "value"], "left_anti")
                       .unionByName(attempts(clash)), "surrogates")
    left = clash.groupBy("kind").agg(F.count("*").alias("n"), F.min("value").alias("least")).orderBy("kind").limit(3).collect()
    raise ValueError(f"no free surrogate after {most_attempts} attempts for "
                     + ", ".join(f"{r['n']} of kind {r['kind']}" for r in left))


def surrogate_texts(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced; other rows and columns as they are.

    ``key`` is the secret that surrogates are drawn with; who has it can test guesses
    of what was replaced.  A column ``n_chars`` is set to the new length where a text
    changes.  ``count_col`` adds the number of mentions.  Null and empty texts hold no
    mention; repeated rows stay and get equal texts; texts of any length are searched
    whole; an empty table stays empty; columns may have any names, those of the work
    tables included.  A text is searched once: rows and spans are written to the shared
    folder.  Only documents with mentions are shuffled, and a text that very many rows
    have is dealt to several tasks.
    """
    p = prefix_for(docs)
    text = quoted(text_col)
    searched = stored(docs.select("*", _searched(text.cast("string")).alias(p + "spans")), "searched")
    none = searched.where(F.col(p + "spans").isNull())
    some = searched.where(F.col(p + "spans").isNotNull()).select(
        F.struct(*[quoted(c) for c in docs.columns]).alias("row"), F.col(p + "spans").alias("spans"), F.md5(text).alias("digest"))
    mentions = stored(some.select("digest", F.explode("spans").alias("m"))
                      .select("digest", "m.kind", "m.value", "m.gender").distinct(), "mentions")
    # f and m come before n: a name has the gender that any text shows
    table = assign(mentions.groupBy("kind", "value").agg(F.min("gender").alias("gender")), key)
    per_text = split_join(mentions.select("digest", "kind", "value").distinct(), table, ["kind", "value"], F.col("digest")) \
        .groupBy("digest").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("entities"))
    # the number deals rows of equal texts to parts; results do not depend on it
    some = split_join(some.withColumn("number", F.monotonically_increasing_id()), per_text, ["digest"], F.col("number"))
    row = F.col("row")
    some = some.withColumn("new", _replaced(row[text_col].cast("string"), F.col("spans"), F.col("entities")))

    def changed(c):
        if c == text_col:
            return F.col("new").alias(c)
        if c == "n_chars":
            return F.char_length("new").cast(docs.schema[c].dataType).alias(c)
        return row[c].alias(c)
    extra = [] if count_col is None else [count_col]
    return none.select(*[quoted(c) for c in docs.columns], *[F.lit(0).cast("long").alias(c) for c in extra]).unionAll(
        some.select(*[changed(c) for c in docs.columns], *[F.size("spans").cast("long").alias(c) for c in extra]))


def session_key(spark: SparkSession) -> str:
    """The key that the session sets for surrogates."""
    return spark.conf.get(KEY_SETTING, TRIAL_KEY)


def surrogate_table(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: the new text and how many mentions it had."""
    return surrogate_texts(docs.select("doc_id", "text"), key, count_col="n_mentions")

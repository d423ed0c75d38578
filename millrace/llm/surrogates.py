"""Surrogates for personal data: keyed, of the same type and format, distinct for distinct entities.

An entity is a type and a canonical value: an e-mail address in lower case, the digits of a telephone or card
number, an IPv4 or full IPv6 address, a secret after a keyword, or a part of a name. A name is found after a title; once found, every
mention of it in the same document is one. All mentions of an entity, however written, get the same surrogate in
the mention's own format, so who is who can still be told. Not found are names without a title anywhere in their
document, names in scripts without capitals, IBANs, national identity numbers, and keys without a keyword.

A surrogate is drawn from an HMAC of the entity under a secret key. Digits become digits, letters letters of the
same case and script, hex digits hex digits; phone numbers keep their country code, cards stay valid or invalid
under the Luhn rule, addresses stay addresses, given names keep the gender that the title says.

Spark gathers the distinct entities, draws for all of them, and draws again where two entities got the same
surrogate or a surrogate is itself an entity of the corpus, until none of this is left. Only those that were drawn
again need to be told to the tasks that rewrite the texts, as all others follow from the key: they are sent to all
tasks if they are at most ``BROADCAST_ROWS``, and joined to the documents that mention them otherwise.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import content_key, settle, small_batches, whole

BROADCAST_ROWS = 50_000
ATTEMPTS = 100

# Titles and the gender they say.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
# Words before a secret.
SECRET_WORDS = ("token", "secret", "password", "apikey", "api_key", "api-key")

_RIGHT = re.compile(r"[\w-]+(?:\.[\w-]+)+")
_NUMBER = re.compile(
    r"(?P<ip6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:]))"
    r"|(?P<phone>\+\d{8,15}(?!\d)|\+\d{1,3} \d(?: \d{2}){4}(?! ?\d)|\+\d{1,3} \d{2,4} \d{5,8}(?!\d)|\+\d{1,3}[ -]?(?:\(\d{2,4}\)[ -]?)?\d{2,4}(?:[ -]\d{2,4}){1,3}(?!\d)"
    r"|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|\d{3}-\d{3}-\d{4}(?![\d-])|\d{3}\.\d{3}\.\d{4}(?![\d.]))"
    r"|(?P<ip>(?:\d{1,3}\.){3}\d{1,3}(?![\d]))"
    r"|(?P<card>\d(?:[ -]?\d){12,18}(?!\d))"
)
_SECRET = re.compile(r"(?:%s)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_\-][A-Za-z0-9_\-./+=]{14,}[A-Za-z0-9_\-=])" % "|".join(map(re.escape, SECRET_WORDS)), re.IGNORECASE)
_NAME = re.compile(r"\b(%s)(\.? )([^\W\d_][\w'-]*)(?: ([^\W\d_][\w'-]*))?" % "|".join(TITLES))
_LETTERS = {"latin": ("abcdefghijklmnopqrstuvwxyz", "àáâäèéêëìíîïòóôöùúûü"), "greek": ("αβγδεζηθικλμνξοπρστυφχψω", ""), "cyrillic": ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "")}
_SYLLABLES = {"latin": ("bdfglmnprstvk", "aeiou"), "greek": ("βγδθκλμνπρστφχ", "αειοω"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу")}
_ENDINGS = {"latin": {"m": ("n", "r", "s", "l"), "f": ("a", "ia", "ine", "elle"), "": ("man", "sen", "er", "ot")}, "greek": {"m": ("ος", "ης", "ας"), "f": ("α", "η", "ια"), "": ("ου", "ακης", "ιδης")}, "cyrillic": {"m": ("ий", "ей", "ан"), "f": ("а", "ия", "ина"), "": ("ов", "ин", "ко")}}

Mention = tuple[int, int, str, str]


def _octets(text: str) -> bool:
    return all(int(x) < 256 for x in text.split("."))


def mentions(text: str | None) -> list[Mention]:
    """(start, end, type, canonical value) of every entity, in order and without overlap."""
    if not text:
        return []
    found: list[Mention] = []
    at = text.find("@")
    while at >= 0:
        right, start = _RIGHT.match(text, at + 1), at
        while right and start and (text[start - 1].isalnum() or text[start - 1] in "_.+-"):
            start -= 1
        while start < at and text[start] == ".":
            start += 1
        if right and start < at:
            found.append((start, right.end(), "email", text[start : right.end()].lower()))
        at = text.find("@", at + 1)
    for m in _NUMBER.finditer(text):
        before, kind = text[m.start() - 1 : m.start()], m.lastgroup
        if before.isalnum() or kind == "ip" and (before == "." or not _octets(m[0])):
            continue
        found.append((m.start(), m.end(), kind, m[0] if kind == "ip" else m[0].lower() if kind == "ip6" else re.sub(r"\D", "", m[0])))
    folded = text.lower() if any(w in text for w in ("oken", "ecret", "assword", "pi", "OKEN", "ECRET", "ASSWORD", "PI")) else ""
    if any(w in folded for w in SECRET_WORDS):
        found += [(m.start(1), m.end(1), "secret", m[1]) for m in _SECRET.finditer(text)]
    if any(t in text for t in TITLES):
        for m in _NAME.finditer(text):
            gender = TITLES[m[1]]
            parts = [(3, "surname")] if m[4] is None or not m[4][0].isupper() else [(3, f"given-{gender}"), (4, "surname")]
            found += [(m.start(g), m.end(g), kind, m[g].lower()) for g, kind in parts if m[g][0].isupper()]
        # a surname before a given name of the same spelling, so that every mention of it is the same entity
        known = {text[s:e]: (k, v) for s, e, k, v in sorted(found, key=lambda f: f[2] == "surname") if k == "surname" or k.startswith("given-")}
        if known:
            again = re.compile(r"(?<![\w'-])(?:%s)(?![\w-])" % "|".join(map(re.escape, sorted(known, key=len, reverse=True))))
            titled = {f[0] for f in found}
            found += [(m.start(), m.end(), *known[m[0]]) for m in again.finditer(text) if m.start() not in titled]
    found.sort(key=lambda f: (f[0], -f[1]))
    out: list[Mention] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def _stream(key: bytes, kind: str, value: str, attempt: int) -> Callable[[int], int]:
    """Numbers below n, one after another, drawn from the keyed hash."""
    state = {"block": 0, "bits": 0, "left": 0}

    def draw(n: int) -> int:
        if state["left"] < 64:
            digest = hmac.new(key, f"{kind}\0{value}\0{attempt}\0{state['block']}".encode(), hashlib.sha256).digest()
            state["bits"], state["left"], state["block"] = int.from_bytes(digest, "big"), 256, state["block"] + 1
        state["bits"], out = divmod(state["bits"], n)
        state["left"] -= n.bit_length()
        return out

    return draw


def _script(letter: str) -> str:
    c = ord(letter)
    return "greek" if 0x370 <= c < 0x400 else "cyrillic" if 0x400 <= c < 0x530 else "latin"


def _like(text: str, draw: Callable[[int], int], hexadecimal: bool = False) -> str:
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw(10)))
        elif hexadecimal and c.lower() in "abcdef":
            out.append("abcdef"[draw(6)].upper() if c.isupper() else "abcdef"[draw(6)])
        elif c.isalpha():
            plain, accented = _LETTERS[_script(c)]
            letters = plain if c.lower() in plain or not accented else accented
            x = letters[draw(len(letters))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (d > "4") for i, d in enumerate(reversed(digits))) % 10


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value."""
    draw = _stream(key, kind, value, attempt)
    if kind == "ip":
        return ".".join(str(1 + draw(254)) for _ in range(4))
    if kind == "ip6":
        return _like(value, draw, True)
    if kind == "phone":
        keep = len(value) - 10 if len(value) > 10 else 0
        return value[:keep] + _like(value[keep:], draw)
    if kind == "card":
        body = _like(value[:-1], draw)
        last = (10 - _luhn(body + "0")) % 10
        return body + str(last if _luhn(value) == 0 else (last + 1 + draw(9)) % 10)
    if kind == "secret":
        return _like(value, draw, bool(re.fullmatch(r"[0-9a-fA-F]+", value)))
    if kind == "email":
        name, _, domain = value.partition("@")
        head, _, top = domain.rpartition(".")
        return f"{_like(name, draw)}@{_like(head, draw)}.{top}"
    script = _script(value[0])
    onsets, vowels = _SYLLABLES[script]
    endings = _ENDINGS[script][kind[6:] if kind.startswith("given-") else ""]
    return "".join(onsets[draw(len(onsets))] + vowels[draw(len(vowels))] for _ in range(2 + min(attempt, 4))) + onsets[draw(len(onsets))] + endings[draw(len(endings))]


def in_format(kind: str, mention: str, canonical: str) -> str:
    """A canonical surrogate written as the mention is."""
    if kind in ("phone", "card"):
        digits = iter(canonical)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "email":
        if mention.isupper():
            return canonical.upper()
        return "".join(c.upper() if m.isupper() else c for m, c in zip(mention, canonical)) if len(mention) == len(canonical) else canonical
    if kind == "ip6":
        return canonical.upper() if mention.isupper() else canonical
    if kind == "surname" or kind.startswith("given-"):
        return canonical.upper() if mention.isupper() and len(mention) > 1 else canonical[0].upper() + canonical[1:]
    return canonical


def rewrite(key: bytes, text: str | None, again: dict[tuple[str, str], int]) -> tuple[str | None, int]:
    """The text with all entities replaced, and how many mentions that were."""
    out, at, found = [], 0, mentions(text)
    for start, end, kind, value in found:
        out += [text[at:start], in_format(kind, text[start:end], surrogate(key, kind, value, again.get((kind, value), 0)))]
        at = end
    return ("".join(out) + text[at:], len(found)) if found else (text, 0)


def _entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = {(kind, value) for text in batch["text"] for _, _, kind, value in mentions(text)}
        yield pd.DataFrame(sorted(found), columns=["kind", "value"], dtype=object)


def _mentioned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(i, k, *e) for i, k, text in zip(batch["id"], batch["text_key"], batch["text"]) for e in sorted({m[2:] for m in mentions(text)})]
        yield pd.DataFrame(rows, columns=["id", "text_key", "kind", "value"]).astype({"id": object, "kind": object, "value": object})


def draw_all(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, surrogate) of distinct ``entities`` (kind, value): no two equal, none an entity.

    An error where an entity finds no free surrogate in ATTEMPTS draws, as when a form's values are used up.
    """

    @F.pandas_udf("string")
    def drawn(kinds: pd.Series, values: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, int(a)) for k, v, a in zip(kinds, values, attempts)], dtype=object)

    group = F.when(F.col("kind").startswith("given-"), "given").otherwise(F.col("kind"))
    own = entities.select(group.alias("group"), F.col("value").alias("surrogate"))
    now = settle(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", drawn("kind", "value", "attempt")))
    while True:
        grouped = now.withColumn("group", group)
        first = grouped.groupBy("group", "surrogate").agg(F.min(F.struct("value", "kind")).alias("first"), F.count("*").alias("n"))
        clash = first.where("n > 1")
        late = grouped.join(clash, ["group", "surrogate"]).where(F.struct("value", "kind") != F.col("first")).select("kind", "value")
        real = grouped.join(own.distinct(), ["group", "surrogate"], "left_semi").select("kind", "value")
        again = settle(late.unionByName(real).distinct())
        if again.isEmpty():
            return now
        if full := now.join(again, ["kind", "value"], "left_semi").where(F.col("attempt") >= ATTEMPTS).select("kind").first():
            raise ValueError(f"no free surrogate for a {full.kind} after {ATTEMPTS} draws: its form has too few values for its entities")
        new = again.join(now, ["kind", "value"]).withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", drawn("kind", "value", "attempt"))
        now = settle(now.join(again, ["kind", "value"], "left_anti").unionByName(new.select(*now.columns)))


def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with rewritten texts in ``text_col`` and the number of rewritten mentions in ``n_replaced``.

    Null texts stay null, texts without personal data stay as they are. Rows that repeat another are rewritten in
    the same way. A column ``n_replaced`` of the input gives way. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c != "n_replaced"]
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), content_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    entities = settle(texts.select("text").mapInPandas(_entities, "kind string, value string").distinct())
    again = settle(draw_all(entities, key).where("attempt > 0").select("kind", "value", "attempt"))
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        told = {(r.kind, r.value): r.attempt for r in again.collect()}

        @F.pandas_udf("text string, n long")
        def rewritten(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([rewrite(key, t, told) for t in texts], columns=["text", "n"])

        out = docs.select(whole(docs), rewritten(F.col(text_col)).alias("new"))
    else:
        met = texts.mapInPandas(_mentioned, "id string, text_key long, kind string, value string").join(again, ["kind", "value"])
        told_each = settle(met.groupBy("id", "text_key").agg(F.collect_set(F.concat_ws("\0", "kind", "attempt", "value")).alias("_again")))

        @F.pandas_udf("text string, n long")
        def rewritten_each(texts: pd.Series, agains: pd.Series) -> pd.DataFrame:
            rows = []
            for text, told in zip(texts, agains):
                split = [x.split("\0", 2) for x in told] if told is not None else []
                rows.append(rewrite(key, text, {(k, v): int(a) for k, a, v in split}))
            return pd.DataFrame(rows, columns=["text", "n"])

        keyed = docs.select(whole(docs), F.col(id_col).cast("string").alias("own_id"), content_key(F.col(text_col)).alias("own_key"), F.col(text_col).alias("text"))
        joined = keyed.join(told_each, (F.col("own_key") == F.col("text_key")) & F.col("own_id").eqNullSafe(F.col("id")), "left")
        out = joined.select("doc", rewritten_each(F.col("text"), F.col("_again")).alias("new"))
    return out.select(*(F.col("new.text" if c == text_col else f"doc.`{c}`").alias(c) for c in columns), F.col("new.n").alias("n_replaced"))

"""PII: detected entities become keyed surrogates of the same type and format.

Entities are e-mail addresses, phone numbers, IPv4, IPv6 and MAC addresses, card
numbers, IBANs, social security numbers, secrets (password = ..., token = ...) and the
names of persons that are somewhere in the text called by a title; from there their given
names and surnames are known wherever the text repeats them. A surrogate is drawn from an
HMAC, under the caller's key, of the type and the normalised value, so the same entity gets
the same surrogate in every document (coreference). A name is replaced part by part, so
"Dr. John Smith", "Mr. Smith" and "John" stay one person. A surrogate keeps the format:
letter and digit classes, case, separators, a card's first digit and check digit, an IBAN's
country and check digits. Addresses come from what is reserved: ``example`` domains,
240.0.0.0/4, 2001:db8::/32, locally administered MACs. Names keep script and gender; a given
name met under neutral titles only has the gender that the corpus gives it elsewhere, if any.

Collisions are checked over the whole corpus: distinct entities and surrogates are
grouped (combined before the shuffle); a surrogate that two entities share, or that
is itself an entity, is drawn again for all but the smallest value, until none is
left; where a format's values run out, surrogates get longer. Given names of all genders are checked together. Only redrawn entities and resolved
genders are sent to the tasks: by broadcast up to ``most`` of them, else joined by document.

Defined results. Null text stays null, empty text empty; text without entities is
unchanged. Empty tables give no rows. A very long text is read whole. Repeated rows are
replaced each, alike. Entities of equal start go to the longer one. Other columns are kept,
whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lorespark.llm.common import written

MOST = 100_000
_KINDS = ArrayType(StringType())

_DIGIT = re.compile("[0-9]")
_KEYWORDS = ("password", "passwd", "pwd", "token", "secret", "apikey", "api-key", "api_key")
_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"""
    r"""|(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b)\s*[=:]\s*["']?(?P<secret>[A-Za-z0-9+/_-]{8,})"""
    r"""|(?P<iban>\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)"""
    r"""|(?P<card>(?<![\w.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\w-]))"""
    r"""|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"""
    r"""|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9]))"""
    r"""|(?P<phone>(?<![\w.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w-]))"""
)
#: By the sign between their parts: looked for only where a text has enough of these.
_COLONS = re.compile(r"(?P<mac>(?<![\w:-])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\w:-]))|(?P<ip6>(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]))")
_HYPHENS = re.compile(r"(?P<mac>(?<![\w:-])(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}(?![\w:-]))")
#: Titles by gender, and syllables and endings by script to make names of.
TITLES = {
    "m": ("Mr", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "господин", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Doña", "Madame", "Mme", "Mlle", "госпожа", "г-жа"),
    "n": ("Dr", "Prof", "Professor"),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ha ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve".split(),
    "cyrillic": "ба бе бо ва ве во га да де до за зе ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то".split(),
}
ENDINGS = {
    "latin": {"given:m": "n r s l".split(), "given:f": "na ra la ia".split(), "given:n": "ne re le ie".split(), "surname": "n r k t".split()},
    "cyrillic": {"given:m": "н р с л".split(), "given:f": "на ра ла ия".split(), "given:n": "не ре ле ие".split(), "surname": "нко рук лик тюк".split()},
}
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_WORD = r"[^\W\d_a-zа-я][^\W\d_]+"
_NAME = re.compile(
    r"\b(?P<title>" + "|".join(sorted(map(re.escape, _TITLE_GENDER), key=len, reverse=True)) + rf")\b\.?[ ](?P<name>{_WORD}(?:-{_WORD})*(?:[ ]{_WORD}(?:-{_WORD})*){{0,2}})"
)


class Stream:
    """Numbers from a keyed digest of the parts."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.count, self.left = key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), 0, 0

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            self.count += 1
            self.left = int.from_bytes(hmac.new(self.key, self.seed + b"\x1f%d" % self.count, hashlib.sha256).digest(), "big")
        self.left, r = divmod(self.left, n)
        return r


def _like(s: str, draw: Stream) -> str:
    """Letter for letter, digit for digit, case kept."""
    out = []
    for c in s:
        if "0" <= c <= "9":
            out.append(str(draw.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + draw.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + draw.below(26)))
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * 2, 10)) if k % 2 else int(d) for k, d in enumerate(digits[::-1])) % 10


def normalised(kind: str, value: str) -> str:
    """The form in which mentions of one entity are equal."""
    if kind == "email":
        return value.lower()
    if kind == "ip6":
        return ipaddress.IPv6Address(value).compressed
    if kind in ("card", "iban", "phone", "ssn", "mac"):
        return re.sub(r"[ .():-]", "", value).lower() if kind == "mac" else re.sub(r"[ .()-]", "", value)
    if kind == "secret" and value.isupper():
        return value.lower()
    if kind in ("surname", "given:m", "given:f", "given:n") and value.isupper():
        return value.title()
    return value


WIDEN = 6  # the draw from which a surrogate gets longer each time, so that no format runs out


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The surrogate of a normalised value; from draw ``WIDEN`` on by a sign more each time, an IPv4 address as an IPv6 one."""
    if attempt < WIDEN or kind == "surname" or kind.startswith("given"):  # names get longer anyway
        return _surrogate(key, kind, value, attempt)
    if kind in ("ip", "ip6"):
        return _surrogate(key, "ip6", value, attempt)
    more, draw = attempt - WIDEN + 1, Stream(key, kind, value, attempt, "more")
    if kind == "email":
        local, at, rest = _surrogate(key, kind, value, attempt).partition("@")
        return local + "".join(chr(97 + draw.below(26)) for _ in range(more)) + at + rest
    signs = "0123456789abcdef" if kind == "mac" else "0123456789"
    return _surrogate(key, kind, value, attempt) + "".join(signs[draw.below(len(signs))] for _ in range(more))


def _surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    draw = Stream(key, kind, value, attempt)
    if kind == "email":
        local, domain = value.split("@")
        labels = domain.split(".")
        if len(labels) == 2:
            return f"{_like(local, draw)}@{_like(labels[0], draw)}.example"
        ending = labels[-1] if labels[-1] in ("com", "org", "net") else "com"
        return f"{_like(local, draw)}@{'.'.join(_like(x, draw) for x in labels[:-2])}.example.{ending}"
    if kind == "ip":
        return ".".join([str(240 + draw.below(15)), *(str(1 + draw.below(254)) for _ in range(3))])
    if kind == "ip6":
        return "2001:db8:" + ":".join(f"{draw.below(1 << 16):x}" for _ in range(6))
    if kind == "mac":
        return "02" + "".join("0123456789abcdef"[draw.below(16)] for _ in value[2:])
    if kind == "card":
        valid = _luhn(value) == 0
        body = value[0] + _like(value[1:-1], draw)
        want = next(d for d in "0123456789" if _luhn(body + d) == 0)
        return body + (want if valid else str((int(want) + 1 + draw.below(9)) % 10))
    if kind == "iban":
        body = _like(value[4:], draw)
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind == "phone":
        tail = 10 if value.startswith("+") else len(value)
        return value[:-tail] + _like(value[-tail:], draw) if len(value) > tail else ("+" if value[0] == "+" else "") + _like(value.lstrip("+"), draw)
    if kind == "ssn":
        return "9" + _like(value[1:], draw)
    if kind == "surname" or kind.startswith("given"):
        script = "cyrillic" if re.search("[А-Яа-яЁё]", value) else "latin"
        stem = [SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(2 + (attempt + 1) // 2)]
        ends = ENDINGS[script][kind]
        return "".join([*stem, ends[draw.below(len(ends))]]).capitalize()
    if re.fullmatch("[0-9a-f]+", value):
        return "".join("0123456789abcdef"[draw.below(16)] for _ in value)
    return _like(value, draw)


def shaped(kind: str, original: str, new: str) -> str:
    """The surrogate in the separators and case of a mention."""
    if kind in ("card", "iban", "phone", "ssn", "mac"):
        letters = iter(re.sub(r"[ .()-]", "", new))
        new = "".join(c if c in " .():-" else next(letters) for c in original) + "".join(letters)  # a widened one goes on
    return new.upper() if kind not in ("iban", "ip6") and original.isupper() else new


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """The parts of titled names, and what the text repeats of them."""
    out: list[tuple[int, int, str, str]] = []
    told: dict[str, str] = {}
    for m in _NAME.finditer(text):
        parts = list(re.finditer(r"[^ ]+", m["name"]))
        for k, part in enumerate(parts):
            kind = "surname" if k == len(parts) - 1 else "given:" + _TITLE_GENDER[m["title"]]
            value = normalised(kind, part[0])
            out.append((m.start("name") + part.start(), m.start("name") + part.end(), kind, value))
            if kind != "surname" and told.get(value, "given:n") != "given:n":
                kind = told[value]  # a gender told once in the text stays
            told[value] = kind
    if out:
        again = re.compile(r"\b(?:" + "|".join(sorted({re.escape(x) for v in told for x in (v, v.upper())}, key=lambda x: (-len(x), x))) + r")\b")
        for m in again.finditer(text):
            value = m[0] if m[0] in told else m[0].title()
            if value in told:
                out.append((*m.span(), told[value], value))
    return out


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normalised value) of a text's entities, in order, not overlapping."""
    if not text:
        return []
    out = []
    low = text.lower()
    if "@" in text or _DIGIT.search(text) or any(w in low for w in _KEYWORDS):  # all that the pattern can match has one of these
        out += [(*m.span(m.lastgroup), m.lastgroup, normalised(m.lastgroup, m[m.lastgroup])) for m in _PATTERN.finditer(text)]
    for pattern in [_COLONS] * (text.count(":") > 1) + [_HYPHENS] * (text.count("-") > 4):
        for m in pattern.finditer(text):
            kind, value = m.lastgroup, m[m.lastgroup]
            if kind == "ip6":
                if len(value) < 4 or value.count(":") < 4 and not re.search("[0-9]", value):  # ::1, a::b
                    continue
                try:
                    ipaddress.IPv6Address(value)
                except ValueError:  # a time of day, a list of numbers
                    continue
            out.append((*m.span(kind), kind, normalised(kind, value)))
    if any(t in text for t in _TITLE_GENDER):
        out += _names(text)
    out.sort(key=lambda e: (e[0], -e[1]))
    kept, end = [], -1
    for e in out:
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


def replaced(text: str | None, key: bytes, known: dict[tuple[str, str], tuple[str, int]]) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the kinds of its entities. ``known``: what isn't drawn as the first of its kind."""
    found = entities(text)
    if not found:
        return text, []
    out, at = [], 0
    for start, end, kind, value in found:
        own, attempt = known.get((kind, value), (kind, 0))
        out += [text[at:start], shaped(own, text[start:end], surrogate(key, own, value, attempt))]
        at = end
    return "".join([*out, text[at:]]), [e[2].split(":")[0] for e in found]


def _found(batches):
    for batch in batches:
        rows = {e[2:] for t in batch.column(0) for e in entities(t.as_py())}
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["kind", "value"])


def _drawn(key: bytes):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *r) for r in rows], pa.string())], names=["kind", "value", "attempt", "surrogate"])

    return run


def _resolved(found: DataFrame) -> DataFrame:
    """(kind, value, own) of entities: given names of unknown gender are those of a known one, where the corpus has it."""
    known = F.max(F.when(F.col("kind") != "given:n", F.col("kind")))
    given = found.where("kind like 'given:%'").groupBy("value").agg(known.alias("own")).where("own is not null")
    x = found.join(given.hint("shuffle_merge"), "value", "left")
    return x.select("kind", "value", F.when(F.col("kind") == "given:n", F.coalesce("own", "kind")).otherwise(F.col("kind")).alias("own"))


def draws(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, own, attempt, surrogate) of every distinct entity: no two of a kind share a surrogate, none is an entity.

    ``own`` is the kind under which it is drawn; given names are of one kind here.
    """
    found = docs.select(F.col("text").cast("string")).mapInArrow(_found, "kind string, value string").distinct()
    found = written(_resolved(written(found, "found")), "entities")
    schema = "kind string, value string, attempt int, surrogate string"
    first = found.select(F.col("own").alias("kind"), "value").distinct().withColumn("attempt", F.lit(0))
    table = written(first.mapInArrow(_drawn(key), schema), "surrogates")
    group = F.split_part("kind", F.lit(":"), F.lit(1)).alias("group")  # what must differ within
    values = table.select(group, F.col("value").alias("surrogate")).distinct()
    while True:  # every draw after the first few has ten times the values of the one before
        own = F.struct("value", "kind")
        named = table.select("*", group)
        firsts = named.groupBy("group", "surrogate").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1").select("group", "surrogate", "first")
        real = named.select("group", "surrogate").join(values.hint("shuffle_merge"), ["group", "surrogate"], "left_semi").distinct().withColumn("real", F.lit(True))
        x = named.join(firsts.hint("shuffle_merge"), ["group", "surrogate"], "left").join(real.hint("shuffle_merge"), ["group", "surrogate"], "left")
        again = (F.col("first").isNotNull() & (own != F.col("first"))) | F.col("real").isNotNull()
        x = written(x.select("kind", "value", "attempt", "surrogate", again.alias("again")), "surrogate-check")
        if x.where("again").isEmpty():
            drawn = x.select(F.col("kind").alias("own"), "value", "attempt", "surrogate")
            return found.join(drawn.hint("shuffle_merge"), ["own", "value"]).select("kind", "value", "own", "attempt", "surrogate")
        redo = x.where("again").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_drawn(key), schema)
        table = written(x.where("not again").drop("again").select("kind", "value", "attempt", "surrogate").unionByName(redo), "surrogates")


_session_keys: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key under ``spark.lorespark.surrogates.key``; where it isn't set, one drawn for this application and kept nowhere."""
    given = spark.conf.get("spark.lorespark.surrogates.key", None)
    if given:
        return given.encode()
    return _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonymised(docs: DataFrame, key: bytes, extra: list[str] | None = None, most: int = MOST) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``entity_kinds`` (array) where ``extra`` asks for it.

    ``key``: who has it can draw the same surrogates again, so it is kept as the texts
    are. ``extra``: the columns to return beside the text; all by default.
    """
    spark = docs.sparkSession
    known = written(draws(docs, key).where("attempt > 0 or kind <> own").select("kind", "value", "own", "attempt"), "redrawn")
    kinds = extra is not None
    columns = list(docs.columns) if extra is None else [*extra, "text"]
    column = columns.index("text")
    source = docs.select(*columns)
    if known.count() <= most:
        sent = spark.sparkContext.broadcast({(r[0], r[1]): (r[2], r[3]) for r in known.collect()})
    else:  # by document: what its entities are drawn as
        sent = None
        row, own = ("_" * (1 + max(map(len, columns))) + x for x in ("row", "known"))  # no column begins like these
        source = written(source.withColumn(row, F.monotonically_increasing_id()), "numbered")
        found = source.select(F.col(row).alias("at"), F.col("text").cast("string")).mapInArrow(_by_row, "at long, kind string, value string")
        of = found.join(known.hint("shuffle_merge"), ["kind", "value"]).groupBy(F.col("at").alias(row)).agg(F.collect_list(F.struct("kind", "value", "own", "attempt")).alias(own))
        source = source.join(of.hint("shuffle_merge"), row, "left").select(*columns, own)

    def run(batches):
        for batch in batches:
            texts = batch.column(column).to_pylist()
            if sent is None:
                maps = [{(x["kind"], x["value"]): (x["own"], x["attempt"]) for x in own or ()} for own in batch.column(len(columns)).to_pylist()]
            else:
                maps = [sent.value] * len(texts)
            new = [replaced(t if t is None else str(t), key, m) for t, m in zip(texts, maps, strict=True)]
            arrays = list(batch.columns)[: len(columns)]
            arrays[column] = pa.array([n[0] for n in new], pa.string())
            names = list(columns)
            if kinds:
                arrays.append(pa.array([n[1] for n in new], pa.list_(pa.string())))
                names.append("entity_kinds")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = docs.select(*columns).schema
    schema.fields[column].dataType = StringType()
    if kinds:
        schema = schema.add("entity_kinds", _KINDS)
    return source.mapInArrow(run, schema)


def _by_row(batches):
    for batch in batches:
        rows = [(i, *e[2:]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for e in entities(t.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64())] + [pa.array([r[k] for r in rows], pa.string()) for k in (1, 2)], names=["at", "kind", "value"])

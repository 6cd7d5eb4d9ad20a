"""Surrogates for personal data."""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shelf, free_name

MALE = "Mr|Herrn|Herr|Monsieur|Señor|Sr|Don|Signor|господин|Господин|κύριος|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|Doña|Signora|госпожа|Госпожа|κυρία|Κυρία"
NEUTRAL = "Dr|Prof|Mx"
#: A name follows these, too.
INTRODUCING = "[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es|[Mm]i chiamo|[Мм]еня зовут|[Μμ]ε λένε"
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Paul Mark George Peter Hans Klaus Jürgen Stefan Wolfgang Pierre Jean Jacques Michel Luc Antoine José Juan Carlos Luis Miguel Javier Antonio Ivan Sergei Dmitri Иван Сергей Дмитрий Алексей Николай Андрей Γιώργος Νίκος Δημήτρης Κώστας".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emma Olivia Anna Petra Sabine Ursula Monika Heike Marie Sophie Camille Chloé Nathalie Isabelle María Carmen Lucía Ana Isabel Elena Анна Мария Елена Ольга Наталья Татьяна Μαρία Ελένη Κατερίνα Σοφία".split(),
}
_GENDER = {n.lower(): g for g, names in GIVEN.items() for n in names}
_NAME = r"[^\W\d_][^\W\d_]*(?:['’-][^\W\d_]+)*"
_POSSESSIVE = re.compile(r"['’][sS]$")
_TITLE = rf"(?:{MALE}|{FEMALE}|{NEUTRAL}|{INTRODUCING})"

ENTITY = re.compile(
    r"(?P<email>[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[opsu]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9]{20,})"
    r"|(?:\b(?:pass(?:word|wd)|pwd|token|secret|api_?key)\s?[=:]\s?[\"']?(?P<secret>[^\s\"'<>,;]{6,}))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\w))"
    r"|(?P<card>(?<![\w.+-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}(?: \d{3})?|\d{4}-\d{4}-\d{4}-\d{4}(?:-\d{3})?|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\w-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w.-])\+\d{7,15}(?!\w))"
    rf"|(?:\b(?P<title>{_TITLE})\b\.?\s(?P<titled>{_NAME}(?:\s{_NAME})?))"
    rf"|(?:\b(?P<given>{'|'.join(n for g in GIVEN.values() for n in g)})\s(?P<family>{_NAME}))"
)
#: Texts without any of these have no entity; three plain searches are faster than the whole pattern.
_DIGIT = re.compile(r"[0-9@]|gh[opsu]_|sk-|pass|pwd|token|secret|api_?key|(?:AKIA|ASIA)")
_PERSON = re.compile(rf"\b(?:{_TITLE}|{'|'.join(n for g in GIVEN.values() for n in g)})\b")
SYLLABLES = {
    "LATIN": ("bar den fel gor han jor kel lin mar nor per ros sel tan vel wen zim dor lam rin".split(), "a", "n"),
    "CYRILLIC": ("бар ден фел гор хан жор кел лин мар нор пер рос сел тан вел зим дор лам рин кум".split(), "а", "н"),
    "GREEK": ("βαρ δεν φελ γορ χαν ζορ κελ λιν μαρ νορ περ ροσ σελ ταν βελ ζιμ δορ λαμ ριν κυμ".split(), "α", "ν"),
}


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN").split()[0]
    return name if name in SYLLABLES else "LATIN"


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity. Forms of one entity that differ in case or separators have one canonical form."""
    out = []
    searching = bool(_DIGIT.search(text) or _PERSON.search(text))
    for m in ENTITY.finditer(text) if searching else ():
        kind = m.lastgroup
        if kind in ("titled", "family"):
            gender = "n"
            if m["title"]:
                gender = "m" if re.fullmatch(MALE, m["title"]) else "f" if re.fullmatch(FEMALE, m["title"]) else "n"
                spans = [(w.start() + m.start("titled"), w.group()) for w in re.finditer(r"\S+", m["titled"])]
                if not spans[0][1][0].isupper():
                    continue
                if len(spans) == 2 and not spans[1][1][0].isupper():
                    spans = spans[:1]
            else:
                if not m["family"][0].isupper():
                    continue
                spans = [(m.start("given"), m["given"]), (m.start("family"), m["family"])]
            for k, (at, w) in enumerate(spans):
                w = _POSSESSIVE.sub("", w)
                given = len(spans) == 2 and k == 0
                g = _GENDER.get(w.lower(), gender) if given else ""
                out.append((at, at + len(w), f"given_{g}" if given else "family", w.lower()))
            continue
        a, b = m.span(kind)
        s = m[kind]
        digits = re.sub(r"\D", "", s)
        if kind == "phone" and not 7 <= len(digits) <= 15:
            continue
        canon = digits if kind in ("card", "phone", "ssn") else s.replace(" ", "") if kind == "iban" else s.lower() if kind == "email" else s
        if drawable(kind, canon):
            out.append((a, b, kind, canon))
    return mentions(text, one_gender(out))


def one_gender(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """found, with each given name of unknown gender given the one that it has elsewhere in the text, if that is one only: Dr. Kim Lee and Mrs. Kim Lee are one person."""
    known: dict[str, set[str]] = {}
    for _, _, kind, canon in found:
        if kind in ("given_m", "given_f"):
            known.setdefault(canon, set()).add(kind)
    return [(a, b, next(iter(known[canon])) if kind == "given_n" and len(known.get(canon, ())) == 1 else kind, canon) for a, b, kind, canon in found]


def mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """found, and each other place where one of its name parts stands alone: capitalised and a whole word, of two letters at least. A part that has two kinds counts as the first one."""
    parts: dict[str, str] = {}
    for _, _, kind, canon in found:
        if (kind == "family" or kind.startswith("given")) and len(canon) > 1:
            parts.setdefault(canon, kind)
    if not parts:
        return found
    starts = [a for a, _, _, _ in found]
    out = list(found)
    bare = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(parts, key=len, reverse=True)))})(?!\w)", re.IGNORECASE)
    for m in bare.finditer(text):
        a, b = m.span()
        canon, k = m.group().lower(), bisect.bisect_right(starts, a)
        if text[a].isupper() and canon in parts and not (k and found[k - 1][1] > a) and not (k < len(found) and starts[k] < b):
            out.append((a, b, parts[canon], canon))
    return sorted(out)


def _class(c: str) -> tuple[str, str]:
    """Script (the first word of the Unicode name) and general category of a character."""
    return unicodedata.name(c, "").split(" ")[0], unicodedata.category(c)


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """The characters of c's script and category in its block of 256, by which a drawn one stays in script and case; basic Latin ones where it has no peer."""
    base, own = ord(c) & ~255, _class(c)
    found = "".join(x for x in map(chr, range(base, base + 256)) if _class(x) == own and len(x.upper()) == 1 and x.upper().lower() == x.lower())
    return found if len(found) > 1 else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "abcdefghijklmnopqrstuvwxyz"


_HEAD = re.compile(r"AKIA|ASIA|gh[opsu]_|sk-|")


def drawable(kind: str, canon: str) -> bool:
    """Whether a surrogate can differ from the entity: a value of symbols only, such as a mask of asterisks, tells nothing and is no entity."""
    drawn = canon.rpartition(".")[0] if kind == "email" else canon[_HEAD.match(canon).end() :] if kind == "secret" else "x"
    return any(map(str.isalnum, drawn))


class Draw:
    """A stream of numbers from HMAC-SHA256 under a key."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.key, self.seed, self.n, self.block, self.used = key, f"{kind}|{canon}|{attempt}".encode(), 0, b"", 0

    def below(self, n: int) -> int:
        if self.used + 4 > len(self.block):
            self.block, self.used = hmac.digest(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256), 0
            self.n += 1
        x = int.from_bytes(self.block[self.used : self.used + 4], "big")
        self.used += 4
        return x % n

    def like(self, c: str) -> str:
        """A character of the same class."""
        if c.isdigit() and c.isascii():
            return "0123456789"[self.below(10)]
        if c.isascii() and c.isalpha():
            return chr((65 if c.isupper() else 97) + self.below(26))
        if c.isalnum():
            same = _alphabet(c)
            return same[self.below(len(same))]
        return c


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """The canonical form of what stands for an entity; a later attempt gives another one."""
    d = Draw(key, kind, canon, attempt)
    longer = lambda c="a": "".join(d.like(c) for _ in range(attempt // 8))  # noqa: E731  where so few characters can be drawn that all their values are taken
    if kind.startswith("given") or kind == "family":
        parts, fem, masc = SYLLABLES[script_of(canon)]
        word = "".join(parts[d.below(len(parts))] for _ in range(3 + attempt // 2))
        return word + (fem if kind == "given_f" else masc if kind == "given_m" else "")
    if kind in ("card", "phone", "ssn"):
        s = canon[0] + "".join(d.like("0") for _ in canon[1:]) + longer("0")
        if kind == "card":
            good = luhn(canon)
            s = next(x for x in (s[:-1] + str((int(s[-1]) + k) % 10) for k in range(10)) if luhn(x) == good)
        return s
    if kind == "ip":
        first = int(canon.split(".")[0])
        kept = {10: [10], 127: [127], 192: [192, 168]}.get(first, []) if first != 192 or canon.startswith("192.168.") else []
        if attempt >= 8:  # the network may be full: then all private and reserved ones, and at last more parts than an address has
            kept = [[10], [127], [240 + d.below(15)]][attempt % 3]
        own = [1 + d.below(223)] if not kept else kept
        while own[0] in (10, 127, 192) and not kept:
            own = [1 + d.below(223)]
        return ".".join(map(str, own + [1 + d.below(254) for _ in range(4 - len(own) + max(0, attempt // 8 - 2))]))
    if kind == "email":
        local, _, domain = canon.partition("@")
        host, _, top = domain.rpartition(".")
        return "".join(map(d.like, local)) + longer() + "@" + "".join(map(d.like, host)) + "." + top
    if kind == "iban":
        body = "".join(map(d.like, canon[4:])) + longer()
        number = "".join(str(int(c, 36)) for c in body + canon[:2])
        return canon[:2] + f"{98 - int(number + '00') % 97:02d}" + body
    head = _HEAD.match(canon).group()
    rest = canon[len(head) :]
    if re.fullmatch(r"[0-9a-f]+", rest):
        return head + "".join("0123456789abcdef"[d.below(16)] for _ in rest) + longer()
    if re.fullmatch(r"[0-9A-Z]+", rest):
        return head + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[d.below(36)] for _ in rest) + longer()
    return head + "".join(map(d.like, rest)) + longer()


def pour(original: str, kind: str, new: str) -> str:
    """new in the format of original: its separators, its letter case."""
    if kind.startswith("given") or kind == "family":
        return new.upper() if len(original) > 1 and original.isupper() else new.title() if original[0].isupper() else new
    if kind in ("card", "phone", "ssn"):
        it = iter(new)
        return "".join([*(next(it) if c.isdigit() else c for c in original), *it])
    if kind == "iban":
        it = iter(new)
        return "".join([*(" " if c == " " else next(it) for c in original), *it])
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new)) if len(original) == len(new) else new
    return new


def mark(key: bytes, kind: str, canon: str) -> str:
    """What stands for an entity in a table that outlives the rounds: it tells nothing without the key."""
    return hmac.digest(key, f"mark|{kind}|{canon}".encode(), hashlib.sha256)[:16].hex()


class Attempts:
    """Attempts by entity, from rows that have marks."""

    def __init__(self, key: bytes, rows: list[dict]):
        self.key, self.by = key, {r["mark"]: r["attempt"] for r in rows}

    def get(self, entity: tuple[str, str], default: int) -> int:
        return self.by.get(mark(self.key, *entity), default)


def replace(text: str, key: bytes, attempts=None) -> tuple[str, int]:
    """text with surrogates, and their number. attempts: of entities (kind, canonical form) whose first surrogate was taken."""
    found, parts, last = find(text), [], 0
    for a, b, kind, canon in found:
        n = attempts.get((kind, canon), 0) if attempts else 0
        parts += [text[last:a], pour(text[a:b], kind, surrogate(key, kind, canon, n))]
        last = b
    return ("".join([*parts, text[last:]]), len(found)) if found else (text, 0)


def surrogates(docs: DataFrame, key: str = "resonara", id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_surrogates") -> DataFrame:
    """docs with each entity in the text replaced, and the number of replacements in ``count_col``.

    Kinds: e-mail and IP addresses, phone, card, social-security and bank-account numbers, access keys and assigned secrets, names after a
    title, a common given name or words that introduce one (my name is ...), and the parts of these names wherever else in the document they stand capitalised. A surrogate is drawn from HMAC-SHA256(key, kind, canonical form): digits for digits, letters for letters of the same script and case, a card
    number stays Luhn-valid or invalid, an account number gets its check digits, given names keep their gender, names their script, and each mention its
    letter case and separators. Mentions of one canonical form get one surrogate all over the corpus. Names are replaced by part, so that a later mention of the family name alone agrees.

    Distinctness: all entities are gathered as a distinct table; a surrogate that two of them share stays with one, and none may
    equal an entity that occurs; others are drawn again, in rounds written to the shared folder, until there is no collision. Only entities drawn
    again need a table: they are joined to the texts that have them by the text's MD5, by broadcast only if Spark finds them small, and all others are
    recomputed from the key. Without any, the texts aren't shuffled. The rounds end: from the eighth attempt on the places grow, of numbers and secrets by a character every eight
    attempts, of addresses to other private and reserved networks and then by parts. Tables with entities in clear are deleted before the result is returned; what it still reads has keyed marks.
    A given name under several titles has one gender in a document, if but one is told.

    Defined cases: a secret or address of symbols only, as a mask of asterisks, is no entity and stays; null text - null and 0; empty text - empty and 0; identifiers play no part, so null or repeated ones change nothing; no rows - no rows; where
    docs has a column named ``count_col``, underscores are appended.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "pii")
    secret = key.encode()

    def gather(batches):
        for batch in batches:
            rows = {(k, c, hashlib.md5(t.encode()).hexdigest()) for t in batch.column(0).to_pylist() if t for _, _, k, c in find(t)}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "canon", "text_md5"])

    seen = shelf.put(docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(gather, "kind string, canon string, text_md5 string"))

    @F.pandas_udf("string")
    def marked(kind, canon):
        return kind.combine(canon, lambda a, b: mark(secret, a, b))

    @F.pandas_udf("string")
    def drawn(kind, canon, attempt):
        return kind.combine(canon, lambda a, b: (a, b)).combine(attempt, lambda x, n: surrogate(secret, x[0], x[1], int(n)))

    # kinds of one shape share a space: a card's surrogate may not be another's phone number
    state = shelf.put(seen.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)).withColumn("new", drawn("kind", "canon", "attempt")))
    real = seen.select(F.col("canon").alias("new")).distinct()
    while True:
        order = Window.partitionBy("new").orderBy("attempt", "kind", "canon")
        taken = state.join(real.withColumn("is_real", F.lit(True)), "new", "left").withColumn("clash", (F.row_number().over(order) > 1) | F.coalesce("is_real", F.lit(False)))
        clashes = shelf.put(taken.where("clash").select("kind", "canon", "attempt"))
        if not clashes.count():
            shelf.drop(clashes)
            break
        again = clashes.withColumn("attempt", F.col("attempt") + 1).withColumn("new", drawn("kind", "canon", "attempt"))
        after = shelf.put(state.join(clashes.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(again))
        shelf.drop(state, clashes)
        state = after
    moved = seen.join(state.where("attempt > 0").select("kind", "canon", "attempt"), ["kind", "canon"]).select("text_md5", "attempt", marked("kind", "canon").alias("mark")).groupBy("text_md5").agg(F.collect_list(F.struct("mark", "attempt")).alias("moved"))
    moved = shelf.put(moved)
    shelf.drop(seen, state)
    count = free_name(docs, count_col)
    rows = docs
    at = docs.columns.index(text_col)
    extra = False
    if moved.count():
        extra = True
        held = free_name(docs, "moved")
        rows = docs.withColumn(free_name(docs, "text_md5"), F.md5(F.col(f"`{text_col}`")))
        digest = rows.columns[-1]
        rows = rows.join(moved.withColumnsRenamed({"text_md5": digest, "moved": held}), digest, "left").select(*[rows[f"`{c}`"] for c in docs.columns], F.col(held))
    fields = T.StructType([*docs.schema.fields, T.StructField(count, T.IntegerType())])

    def run(batches):
        for batch in batches:
            own = batch.column(batch.num_columns - 1).to_pylist() if extra else [None] * batch.num_rows
            done = [(t, 0) if not t else replace(t, secret, Attempts(secret, m) if m else None) for t, m in zip(batch.column(at).to_pylist(), own)]
            cols = list(batch.columns[: len(docs_columns)])
            cols[at] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array([n for _, n in done], pa.int32())], names=fields.names)

    docs_columns = docs.columns
    return rows.mapInArrow(run, fields)

"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier cues.
At each anchor a parser for its kind expands to both sides and validates what it has found:

* email, ip, card, phone: the base kinds, leftmost and without overlap within a kind;
* account: user and password before the host of a URL (`scheme://user:secret@host`), an IBAN whose check
  digits hold, or a number of 6 to 18 digits that follows the words account, acct or ssn and one of `:#=`;
* secret: a value of 8 or more characters that follows password, passwd, secret, token or api key and `=` or `:`.

Spans are code point offsets, end exclusive. Defined results: null and empty texts have none; repeated rows
give a row each; spans of different kinds may overlap; texts may be of any length; an empty table gives an
empty result; other columns are kept by mask() and not read by spans().
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import read, schema_of, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret")
ORDER = {k: n for n, k in enumerate(KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
ADDRESS = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)").match
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])++").match
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
USERINFO = re.compile(r"[^\s/?#@<>\"']++@(?=[A-Za-z0-9\[])").match
NUMBER = re.compile(r"(?:\s?(?:no|number|nr|id)\.?)?\s{0,3}[:#=]\s{0,3}([0-9](?:[ -]?[0-9]){5,17})(?![0-9])", re.I).match
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Characters from a cue, or from the number before, within which an account number starts.
NEAR = 60
#: Characters of a match of IBAN at most.
LONGEST = 64
# Length of account numbers by country.
LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27,
    GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27,
    MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23,
    TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
VALUE = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/.~-]{8,})").match
DIGITS = frozenset("0123456789")


def automaton() -> ahocorasick.Automaton:
    cues = {"@": "email", "+": "phone", "://": "url"} | dict.fromkeys(DIGITS, "digit")
    cues |= dict.fromkeys(("iban", "IBAN", "Iban"), "iban")
    for word in ("account", "acct", "ssn"):
        cues |= dict.fromkeys((word, word.upper(), word.capitalize()), "account")
    for word in ("password", "passwd", "secret", "token", "api_key", "apikey", "api key"):
        cues |= dict.fromkeys((word, word.upper(), word.capitalize()), "secret")
    auto = ahocorasick.Automaton()
    for cue, kind in cues.items():
        auto.add_word(cue, kind)
    auto.make_automaton()
    return auto


ANCHORS = automaton()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str, low: int, high: int) -> tuple[list[tuple[int, int]], int]:
    """(start, end) of the account numbers that start in low:high, or within NEAR of the end of one that does, and where the search ended.

    A number is cut to the length of its country, of an unknown one it is the longest whose check digits hold. No place is tried twice, if
    a later search starts where this one has ended.
    """
    out = []
    while (m := IBAN.search(text, low, high + LONGEST)) and m.start() < high:
        places = [k for k in range(m.start(), m.end()) if text[k] != " "]
        want = LENGTHS.get(m.group()[:2])
        low = m.start() + 1
        for size in range(len(places), 14, -1) if want is None else [want]:
            if size <= len(places) and iban_holds(text[m.start() : places[size - 1] + 1]):
                low = places[size - 1] + 1
                high = low + NEAR
                out.append((m.start(), low))
                break
    return out, high


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order of start, then of kind."""
    out, done = [], dict.fromkeys((*KINDS, "iban"), 0)
    for end, kind in ANCHORS.iter(text):
        at = end
        if kind == "digit":
            if at >= done["card"] and (m := CHAIN(text, at)):
                done["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, m.end(), "card"))
            if at >= done["ip"] and (at == done["ip"] or at == 0 or text[at - 1] not in DIGITS) and (m := ADDRESS(text, at)):
                done["ip"] = m.end()
                if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
                    out.append((at, m.end(), "ip"))
        elif kind == "email":
            low = at
            while low > done["email"] and text[low - 1] in LOCAL:
                low -= 1
            if low < at and (m := DOMAIN(text, at + 1)):
                done["email"] = m.end()
                out.append((low, m.end(), "email"))
        elif kind == "phone":
            if at >= done["phone"] and (m := DIALLED(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in DIGITS for c in m.group()) <= 15:
                    out.append((at, m.end(), "phone"))
        elif kind == "url":
            if m := USERINFO(text, end + 1):
                out.append((end + 1, m.end() - 1, "account"))
        elif kind == "iban":
            low = max(end + 1, done["iban"])
            if low < end + 1 + NEAR:
                numbers, done["iban"] = ibans(text, low, end + 1 + NEAR)
                out += [(*n, "account") for n in numbers]
        elif kind == "account":
            if (m := NUMBER(text, end + 1)) and m.start(1) >= done["account"]:
                done["account"] = m.end(1)
                out.append((m.start(1), m.end(1), "account"))
        elif (m := VALUE(text, end + 1)) and m.start(1) >= done["secret"]:
            done["secret"] = m.end(1)
            out.append((m.start(1), m.end(1), "secret"))
    out.sort(key=lambda s: (s[0], ORDER[s[2]]))
    return out


def spans(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, spans): spans is an array of (kind, start, end) in order of start, then of kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in find(t)] for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["id", "spans"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, schema_of(src.schema["id"].dataType, "spans array<struct<kind:string,start:bigint,end:bigint>>"))


def masked(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one of the first kind."""
    out, at = [], 0
    for s, e, kind in find(text):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def mask(docs: DataFrame, text_col="text", length_col="n_chars") -> DataFrame:
    """docs with personal data masked in text_col; length_col, if there is one, follows. Null stays null."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: None if t is None else masked(t))

    out = docs.withColumn(text_col, run(text_col))
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out


def op3(spark, sf_dir: str) -> DataFrame:
    found = spans(read(spark, sf_dir, "documents", "doc_id", "text"))
    written = lambda kinds: F.concat_ws(",", F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in BASE], F.sha2(written(BASE), 256).alias("base_sha256"), written(KINDS).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def brute(text: str) -> tuple[dict[str, int], str]:
    """The base kinds by plain regular expressions: counts and digest, for tests."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub(r"[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
    }
    got = [(m.start(), ORDER[k], k, m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m.group())]
    line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(got))
    return {k: sum(g[2] == k for g in got) for k in BASE}, hashlib.sha256(line.encode()).hexdigest()

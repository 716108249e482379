"""Validators of values: for the scan kernel in Python, and as native column expressions."""

from __future__ import annotations

import base64
import ipaddress
import json
import math
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# IBAN lengths by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
# Issuer ranges that a card number starts with.
CARD_PREFIX = (
    "^(4|5[1-5]|2(2[2-9][1-9]|2[3-9][0-9]|[3-6][0-9][0-9]|7[01][0-9]|720)|3[47]|3(0[0-5]|[68])|35(2[89]|[3-8][0-9])"
    "|6(011|5|4[4-9])|508|60|65|81|82|353|356|62|5018|5020|5038|56|57|58|6304|6759|676[1-3])"
)
# Words and shapes that stand for a secret but are none.
PLACEHOLDER = re.compile(r"(x+|\*+|\.+|<[^>]*>|\$\{[^}]*\}|\{\{[^}]*\}\}|your[_-]?\w*|changeme|password|secret|example|placeholder|redacted|null|none|undefined|true|false)\Z", re.I)


def _verhoeff_tables() -> tuple[list[list[int]], list[list[int]]]:
    """Multiplication in the dihedral group of order ten, and the powers of its permutation."""
    d = [[((a + b) % 5) if a < 5 and b < 5 else 5 + (a + b - 5) % 5 if a < 5 else 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
    step, p = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    for _ in range(7):
        p.append([step[x] for x in p[-1]])
    return d, p


VERHOEFF_D, VERHOEFF_P = _verhoeff_tables()


def digits(value: str) -> str:
    return re.sub(r"[^0-9]", "", value)


def luhn(value: str) -> bool:
    d = digits(value)
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
    return len(d) >= 2 and total % 10 == 0


def card(value: str) -> bool:
    d = digits(value)
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and re.match(CARD_PREFIX, d) is not None and luhn(d)


def verhoeff(value: str) -> bool:
    c, d = 0, digits(value)
    for k, x in enumerate(reversed(d)):
        c = VERHOEFF_D[c][VERHOEFF_P[k % 8][int(x)]]
    return bool(d) and c == 0


def aadhaar(value: str) -> bool:
    d = digits(value)
    return len(d) == 12 and d[0] >= "2" and len(set(d)) > 1 and verhoeff(d)


def iban(value: str) -> bool:
    v = re.sub(r"[\s-]", "", value).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", v):
        return False
    want = IBAN_LENGTHS.get(v[:2])
    if len(v) != want if want else not 15 <= len(v) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def ssn(value: str) -> bool:
    d = digits(value)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def secret(value: str, least: float = 3.0) -> bool:
    return len(value) >= 8 and not PLACEHOLDER.match(value) and not re.fullmatch(r"\[[A-Z_]+_[0-9]+\]", value) and entropy(value) >= least


def jwt(value: str) -> bool:
    head = value.split(".")[0]
    try:
        got = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, UnicodeDecodeError):
        return False
    return isinstance(got, dict) and "alg" in got


# Address ranges by class, the first that holds the address decides; and names that only resolve inside.
RANGES = {
    "metadata": ["169.254.169.254/32", "100.100.100.200/32", "fd00:ec2::254/128"],
    "unspecified": ["0.0.0.0/8", "::/128"],
    "loopback": ["127.0.0.0/8", "::1/128"],
    "private": ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10", "fc00::/7"],
    "link-local": ["169.254.0.0/16", "fe80::/10"],
    "reserved": ["192.0.0.0/24", "198.18.0.0/15", "240.0.0.0/4"],
    "multicast": ["224.0.0.0/4", "ff00::/8"],
}
METADATA_NAMES = ["metadata.google.internal", "metadata", "instance-data", "instance-data.ec2.internal", "metadata.azure.com"]
INTERNAL_NAMES = [".localhost", ".local", ".internal", ".intranet", ".corp", ".lan", ".home", ".home.arpa", ".private", ".localdomain", ".svc", ".cluster.local"]
_NETWORKS = [(c, ipaddress.ip_network(n)) for c, ns in RANGES.items() for n in ns]


def host_class(host: str) -> str:
    """public, loopback, private, link-local, unspecified, metadata, multicast, reserved or internal-name."""
    h = host.lower().removesuffix(".").removeprefix("[").removesuffix("]")
    try:
        ip = ipaddress.ip_address(h.split("%")[0])
    except ValueError:
        if re.fullmatch("0x[0-9a-f]+|[0-9]+", h):  # a number is an address in disguise
            return "reserved"
        if h in METADATA_NAMES:
            return "metadata"
        if h == "localhost":
            return "loopback"
        return "internal-name" if "." not in h or any(h.endswith(x) for x in INTERNAL_NAMES) else "public"
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return next((c for c, n in _NETWORKS if ip.version == n.version and ip in n), "public")


def url_class(url: str) -> str | None:
    """Class of a URL's host; None if it has none."""
    try:
        host = urlsplit(url).hostname
    except ValueError:
        return None
    return host_class(host) if host else None


def public_url(url: str, protocols: tuple[str, ...] = ("https",)) -> bool:
    """Whether a URL has an allowed protocol, no credentials, and a host that is public by its name or address; names aren't resolved."""
    try:
        parts = urlsplit(url)
        return parts.scheme in protocols and not parts.username and not parts.password and bool(parts.hostname) and host_class(parts.hostname) == "public"
    except ValueError:
        return False


def supports_language(languages: list[str], language: str | None) -> bool:
    """A detector without languages, or with `*`, reads all texts; a text of no or mixed language is read by all detectors."""
    return not languages or language in (None, "", "mixed") or "*" in languages or language.lower().split("-")[0] in languages


# Native expressions -------------------------------------------------------------------------------------------


def digits_col(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_col(c: Column) -> Column:
    return (F.length(digits_col(c)) >= 2) & F.call_function("luhn_check", digits_col(c))


def card_col(c: Column) -> Column:
    d = digits_col(c)
    return F.length(d).between(13, 19) & ~d.rlike(r"^(\d)\1*$") & d.rlike(CARD_PREFIX) & F.call_function("luhn_check", d)


def ssn_col(c: Column) -> Column:
    d = digits_col(c)
    return d.rlike(r"\A(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}\z")


def verhoeff_col(c: Column) -> Column:
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in VERHOEFF_D])
    powers = F.array(*[F.array(*[F.lit(x) for x in row]) for row in VERHOEFF_P])
    d = F.split(F.reverse(digits_col(c)), "")
    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("k"))
    fold = F.aggregate(d, start, lambda s, x: F.when(x == "", s).otherwise(F.struct(table[s.c][powers[s.k % 8][x.cast("int")]].alias("c"), (s.k + 1).alias("k"))), lambda s: s.c)
    return (digits_col(c) != "") & (fold == 0)


def aadhaar_col(c: Column) -> Column:
    d = digits_col(c)
    return (F.length(d) == 12) & d.rlike("^[2-9]") & ~d.rlike(r"^(\d)\1+$") & verhoeff_col(c)


def iban_col(c: Column) -> Column:
    v = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    want = F.element_at(lengths, F.substring(v, 1, 2))
    turned = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    value = lambda x: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), x) - 1
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, x: F.when(x == "", r).otherwise((r * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97))
    fits = F.when(want.isNull(), F.length(v).between(15, 34)).otherwise(F.length(v) == want)
    return F.coalesce(v.rlike(r"\A[A-Z]{2}[0-9]{2}[A-Z0-9]+\z") & fits & (rest == 1), F.lit(False))


def entropy_col(c: Column) -> Column:
    letters = F.array_sort(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")))
    n = F.length(c).cast("double")
    share = lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n
    return F.when(F.length(c) == 0, 0.0).otherwise(-F.aggregate(F.transform(letters, lambda x: share(x) * F.log2(share(x))), F.lit(0.0), lambda s, x: s + x))


def host_class_col(c: Column) -> Column:
    """host_class as an expression; only hosts with a colon (IPv6) go through an Arrow function."""
    h = F.regexp_replace(F.regexp_replace(F.lower(c), r"\.\z", ""), r"\A\[|\]\z", "")
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    part = lambda k: F.call_function("split_part", h, F.lit("."), F.lit(k + 1)).try_cast("bigint")
    number = part(0) * 2**24 + part(1) * 2**16 + part(2) * 2**8 + part(3)
    four = F
    for kind, net in _NETWORKS:
        if net.version == 4:
            four = four.when(number.between(int(net.network_address), int(net.broadcast_address)), F.lit(kind))
    four = four.otherwise(F.lit("public"))
    inside = ~F.contains(h, F.lit(".")) | F.array_contains(F.transform(F.array(*map(F.lit, INTERNAL_NAMES)), lambda x: F.endswith(h, x)), True)
    named = F.when(h.rlike(r"\A(0x[0-9a-f]+|[0-9]+)\z"), "reserved").when(h.isin(METADATA_NAMES), "metadata").when(h == "localhost", "loopback").when(inside, "internal-name").otherwise("public")
    return F.when(F.contains(h, F.lit(":")), _host_class_arrow(F.when(F.contains(c, F.lit(":")), c))).when(h.rlike(rf"\A{octet}(\.{octet}){{3}}\z"), four).otherwise(named)


@F.arrow_udf(StringType())
def _host_class_arrow(hosts: pa.Array) -> pa.Array:
    return pa.array([None if h is None else host_class(h) for h in hosts.to_pylist()], pa.string())


def language_supported(languages: list[str], language: Column) -> Column:
    """supports_language as an expression."""
    if not languages or "*" in languages:
        return F.lit(True)
    return language.isNull() | language.isin("", "mixed") | F.call_function("split_part", F.lower(language), F.lit("-"), F.lit(1)).isin(languages)


def script_counts(c: Column) -> dict[str, Column]:
    head = F.substring(c, 1, 20_000)
    return {s: F.length(F.regexp_replace(head, rf"[^\p{{Is{s}}}]", "")) for s in ("Latin", "Devanagari", "Tamil")}


def language_col(c: Column) -> Column:
    """en, hi, ta, mixed, or null: a script counts from 15 % of the letters of the three on."""
    n = script_counts(c)
    total = n["Latin"] + n["Devanagari"] + n["Tamil"]
    big = {k: v >= 0.15 * total for k, v in n.items()}
    many = sum((b.cast("int") for b in big.values()), F.lit(0))
    return F.when(total == 0, None).when(many > 1, "mixed").when(big["Devanagari"], "hi").when(big["Tamil"], "ta").otherwise("en")

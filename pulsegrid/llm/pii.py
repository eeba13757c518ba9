"""Format-preserving pseudonyms of personal data, in DataFrame functions only.

Dates, national and card numbers, addresses of hosts, phone numbers and mail addresses
are found in every text, validated, and replaced by another value of the same format. A
keyed Feistel network permutes the values of a format: eight rounds, each adding a
digest of the key, the round and one half to the other half. A permutation never maps
two values to one, and one value has the same pseudonym in every document, so records
stay linked; with the key, `inverse=True` brings the originals back. A card in a longer
chain of groups of four is permuted again as long as the new chain would be read otherwise;
only there the pseudonym can depend on the digits around.

What is permuted, by kind:
- date (valid, 1900-01-01 and 72,999 days on; yyyy-mm-dd, dd.mm.yyyy, mm/dd/yyyy): the day;
- ssn (ddd-dd-dddd, valid area, group and serial): the number among the valid ones;
- ip (four numbers to 255): the 32-bit address;
- phone (international, or with area code; 7 to 15 digits, no country code beginning with 0): the digits after the country code;
- card (13 to 19 digits, valid check digit): all digits but the check digit, which is computed anew. At any
  separator of a run of digits, however long, a card of 4-4-4-4, 4-6-5 or unbroken digits can begin; in a chain of
  groups of four that is longer than a card, the first valid one from each place on. What is left of a run is taken
  from its beginning in the longest parts of 13 to 19 digits, whatever their groups;
- email (local part to 64 characters, domain to 253, its labels to 63 and without hyphens at an end): letters and digits of the local part, each within its class.
What looks alike but isn't valid stays as it is.

Null texts stay null and have no spans. Rows are independent: ids may be null or repeat.
An empty table gives an empty result. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import bound, totals_before

#: The kinds and their patterns, tried in this order at each place.
KINDS = {
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![/-]?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![.-]?\d)",
    "card": "",  # below, since it names the others
    # The domain is one character at a time, no two dots together, so the matcher loops over it and doesn't recurse.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-](?:(?!\.\.)[A-Za-z0-9.-])*\.[A-Za-z]{2,}",
}
_OTHERS = "|".join(KINDS[k] for k in ("date", "ssn", "ip", "phone"))
_FORMS = r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d)|\d{4}[ -]\d{6}[ -]\d{5}(?!\d)|\d{13,19}(?!\d)"
_SEP = f"[ -](?!{_OTHERS})"
#: A chain of four groups of four or more, after which 6-5 can follow; another form; or digits to 19 up to where a form or another kind begins.
KINDS["card"] = (
    rf"(?<!\d)(?:\d{{4}}(?:{_SEP}\d{{4}}(?!\d)){{3,}}+(?:{_SEP}\d{{6}}{_SEP}\d{{5}}(?!\d))?|\d{{4}}{_SEP}\d{{6}}{_SEP}\d{{5}}(?!\d)|\d{{13,19}}(?!\d)"
    rf"|\d(?:(?![ -](?:{_FORMS}|{_OTHERS}))[ -]?\d){{12,18}}(?!\d))"
)
PATTERN = f"(?=[0-9+(])(?:{'|'.join(p for k, p in KINDS.items() if k != 'email')})|{KINDS['email']}"

#: Card numbers at separators of a chain, one for each place where one can begin, and the length of the last of them if it isn't of groups of four.
CARD_IN_CHAIN, LAST_LENGTH = r"(?<!\d)(?=(\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))", 17
LONGEST_CARD = 19

ROUNDS = 8
#: A run is read otherwise about once in ten times, so this many are never needed.
MOST_WALKS = 100
FIRST_DAY, DAYS = "1900-01-01", (250, 292)
AREAS, GROUPS, SERIALS = 898, 99, 9999
#: What the standards for numbers and addresses allow.
PHONE_DIGITS = (7, 15)
LONGEST_LOCAL, LONGEST_DOMAIN, LONGEST_LABEL = 64, 253, 63


class Permuter:
    """SQL expressions that pseudonymise one match `m`; null where it isn't valid.

    They name the column that holds the key's digest, and never the digest itself.
    """

    def __init__(self, key: str, inverse: bool):
        self.key, self.sign = key, -1 if inverse else 1
        self.turns = f"array({', '.join(map(str, range(ROUNDS)[:: self.sign]))})"

    def _noise(self, tweak: str, turn: str, half: str) -> str:
        """Thirteen hexadecimal digits of a keyed digest, as a number."""
        return f"{self.sign} * cast(conv(substring(sha2(concat_ws('|', {self.key}, '{tweak}', {turn}, {half}), 256), 1, 13), 16, 10) AS bigint)"

    def pair(self, x: str, y: str, sizes: tuple[int, int], tweak: str) -> str:
        """A permutation of pairs of numbers below the two sizes, as a struct (x, y)."""
        on_x = f"pmod(s.x + {self._noise(tweak, 'r', 's.y')}, {sizes[0]})"
        on_y = f"pmod(s.y + {self._noise(tweak, 'r', 's.x')}, {sizes[1]})"
        start = f"named_struct('x', cast({x} AS bigint), 'y', cast({y} AS bigint))"
        return f"aggregate({self.turns}, {start}, (s, r) -> if(r % 2 = 1, named_struct('x', s.x, 'y', {on_y}), named_struct('x', {on_x}, 'y', s.y)))"

    def characters(self, letters: str, tweak: str) -> str:
        """A permutation of arrays of ASCII letters and digits that keeps each one's class."""

        def shifted(half: str, other: str) -> str:
            base, count = "if(ascii(c) < 58, 48, if(ascii(c) < 91, 65, 97))", "if(ascii(c) < 58, 10, 26)"
            noise = self._noise(tweak, "r", f"concat_ws('|', array_join({other}, ''), i)")
            return f"transform({half}, (c, i) -> char({base} + pmod(ascii(c) - {base} + {noise}, {count})))"

        start = "named_struct('x', slice(w, 1, cast(size(w) / 2 AS int)), 'y', slice(w, cast(size(w) / 2 AS int) + 1, size(w)))"
        turn = f"if(r % 2 = 1, named_struct('x', s.x, 'y', {shifted('s.y', 's.x')}), named_struct('x', {shifted('s.x', 's.y')}, 'y', s.y))"
        return let("w", letters, f"aggregate({self.turns}, {start}, (s, r) -> {turn}, s -> concat(s.x, s.y))")

    def date(self) -> str:
        day = "datediff(d, date'1900-01-01')"
        days = DAYS[0] * DAYS[1]
        moved = let("p", self.pair(f"floor({day} / {DAYS[1]})", f"{day} % {DAYS[1]}", DAYS, "date"), f"date_add(date'{FIRST_DAY}', cast(p.x * {DAYS[1]} + p.y AS int))")

        def form(f: str) -> str:
            return let("d", f"to_date(try_to_timestamp(m, '{f}'))", f"if({day} >= 0 AND {day} < {days}, date_format({moved}, '{f}'), NULL)")

        return f"CASE WHEN m LIKE '__/%' THEN {form('MM/dd/yyyy')} WHEN m LIKE '__.%' THEN {form('dd.MM.yyyy')} ELSE {form('yyyy-MM-dd')} END"

    def ssn(self) -> str:
        area, group, serial = "cast(substring(m, 1, 3) AS int)", "cast(substring(m, 5, 2) AS int)", "cast(substring(m, 8, 4) AS int)"
        place = f"(if({area} > 666, {area} - 2, {area} - 1) * {GROUPS} + {group} - 1)"
        text = f"format_string('%03d-%02d-%04d', if(p.x >= 665 * {GROUPS}, 2, 1) + p.x div {GROUPS}, p.x % {GROUPS} + 1, p.y + 1)"
        moved = let("p", self.pair(place, f"{serial} - 1", (AREAS * GROUPS, SERIALS), "ssn"), text)
        return f"if({area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0, {moved}, NULL)"

    def ip(self) -> str:
        moved = let("p", self.pair("n[0] * 256 + n[1]", "n[2] * 256 + n[3]", (65536, 65536), "ip"), "concat_ws('.', p.x div 256, p.x % 256, p.y div 256, p.y % 256)")
        parts = "transform(split(m, r'\\.'), x -> cast(x AS bigint))"
        return f"if(m RLIKE r'(^|\\.)0\\d', NULL, {let('n', parts, f'if(forall(n, x -> x < 256), {moved}, NULL)')})"

    def phone(self) -> str:
        country = "if(m RLIKE r'^\\+\\d{1,3}[ .(-]', regexp_extract(m, r'^\\+\\d{1,3}', 0), regexp_extract(m, r'^\\+\\d', 0))"
        body = let("b", "substring(m, length(c0) + 1)", f"concat(c0, {refill('b', '[0-9]', self.characters(letters('b', '[^0-9]'), 'phone'))})")
        digits = "length(regexp_replace(m, r'[^0-9]', ''))"
        return f"if({digits} BETWEEN {PHONE_DIGITS[0]} AND {PHONE_DIGITS[1]} AND NOT startswith(m, '+0'), {let('c0', country, body)}, NULL)"

    def card(self, m: str = "m") -> str:
        new = self.characters("slice(d, 1, size(d) - 1)", "card")
        check = f"cast(pmod(-({luhn('v', 0)}), 10) AS string)"
        moved = let("v", new, refill(m, "[0-9]", f"concat(v, array({check}))"))
        return let("d", letters(m, "[^0-9]"), f"if({luhn('d', 1)} % 10 = 0, {moved}, NULL)")

    def card_hit(self) -> str:
        """The hit of a card's match: all of it, or in a longer chain the cards from place to place."""
        short = let("y", self.card(), hit_of("'card'", "y"))
        found = let("out", self._cards_of_chain(), f"if(size(out) > 0, {self._chain_hit()}, {hit_of(chr(39) + 'card' + chr(39), 'NULL')})")
        return f"if(length(regexp_replace(m, r'[^0-9]', '')) > {LONGEST_CARD}, {found}, {short})"

    def _chain_hit(self) -> str:
        """The hit of a chain with cards `out` in it."""
        gap = "substring(m, if(i = 0, 1, out[i - 1].at + out[i - 1].size + 1), out[i].at - if(i = 0, 0, out[i - 1].at + out[i - 1].size))"
        whole = f"concat(array_join(transform(out, (o, i) -> concat({gap}, o.card)), ''), substring(m, element_at(out, -1).at + element_at(out, -1).size + 1))"
        return hit_of("'card'", whole, "transform(out, o -> named_struct('at', o.at, 'size', o.size, 'valid', true))")

    def _cards_of_chain(self) -> str:
        """(at, size, card) of each card of a chain and its pseudonym: the first valid one from the place on where the last one ended.

        `near` are the last places before a card where one could begin, and none was valid:
        none may be with the new digits, or the chain would be read otherwise. They end within the card.
        """
        valid = lambda text: let("d", letters(text, "[^0-9]"), f"{luhn('d', 1)} % 10 = 0")
        overlaid = "concat(substring(q.card, 1, at - q.at), substring(y, 1, length(q.card) - at + q.at))"
        read_alike = f"forall(s.near, q -> if(q.at + length(q.card) > at, NOT {valid(overlaid)}, true))"
        step = f"if(z.done, z, {let('y', self.card('z.card'), f'named_struct({chr(39)}card{chr(39)}, y, {chr(39)}done{chr(39)}, {read_alike})')})"
        walked = f"aggregate(sequence(1, {MOST_WALKS}), named_struct('card', u, 'done', false), (z, q) -> {step}, z -> z.card)"
        none = "cast(array() AS array<struct<at:int,size:int,card:string>>)"
        start = f"named_struct('free', 0, 'out', {none}, 'near', {none})"
        place = lambda card: f"named_struct('at', at, 'size', length(u), 'card', {card})"
        taken = f"named_struct('free', at + length(u), 'out', concat(s.out, array({place(walked)})), 'near', {none})"
        passed = f"named_struct('free', s.free, 'out', s.out, 'near', slice(concat(array({place('u')}), s.near), 1, 3))"
        one = let("at", f"if(length(u) = {LAST_LENGTH}, length(m) - {LAST_LENGTH}, 5 * i)", f"if(at < s.free, s, if({valid('u')}, {taken}, {passed}))")
        windows = f"regexp_extract_all(m, r'{CARD_IN_CHAIN}', 1)"
        return let("w", windows, f"aggregate(sequence(0, size(w) - 1), {start}, (s, i) -> {let('u', 'w[i]', one)}, s -> s.out)")

    def email(self) -> str:
        local = refill("b", "[A-Za-z0-9]", self.characters(letters("b", "[^A-Za-z0-9]"), "email"))
        domain = "substring_index(m, '@', -1)"
        labels = f"forall(split({domain}, r'\\.'), x -> length(x) BETWEEN 1 AND {LONGEST_LABEL} AND x NOT LIKE '-%' AND x NOT LIKE '%-')"
        moved = let("b", "substring_index(m, '@', 1)", f"concat({local}, '@', {domain})")
        return f"if(locate('@', m) <= {LONGEST_LOCAL} + 1 AND length({domain}) <= {LONGEST_DOMAIN}, if({labels}, {moved}, NULL), NULL)"


def hit_of(kind: str, new: str, parts: str = "") -> str:
    """What is known of a match `m`: what stands for it, and where in it values are, all of it unless said otherwise."""
    whole = f"array(named_struct('at', 0, 'size', length(m), 'valid', {new} IS NOT NULL))"
    return f"named_struct('kind', {kind}, 'old', m, 'new', cast({new} AS string), 'parts', {parts or whole})"


def let(name: str, value: str, body: str) -> str:
    """An expression with a value computed once and named."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def letters(text: str, other: str) -> str:
    """The characters of a text without those of a class, as an array."""
    return f"filter(split(regexp_replace({text}, r'{other}', ''), ''), c -> c <> '')"


def refill(text: str, wanted: str, new: str) -> str:
    """The text with its characters of a class replaced one by one from an array."""
    each = "transform(sequence(0, size(g) - 1), i -> concat(g[i], coalesce(get(f, i), '')))"
    return let("f", new, let("g", f"split({text}, r'{wanted}')", f"array_join({each}, '')"))


def luhn(digits: str, first_doubled: int) -> str:
    """The sum of an array of digits from the last on, those at places `first_doubled` and every second after it doubled."""
    d = "cast(c AS int)"
    term = f"if(i % 2 = {first_doubled}, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d})"
    return f"aggregate(transform(reverse({digits}), (c, i) -> {term}), 0, (a, x) -> a + x)"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """All columns, the text replaced, and `pii`: an array of (kind, start, end, was_valid) in the original's code points.

    The text is split at its matches once; each match is replaced by itself, and all
    are put together again. A column named `pii` in the input is replaced by the result's.

    Whoever has the key's digest can undo pseudonyms, so neither is in a plan or in an
    event log: the digest is a row of a table, and reaches the tasks as the value of a
    subquery.
    """
    permuter = Permuter("secret", inverse)
    # A card's pattern looks at what is around it, so a card is what is none of the others.
    kind = " ".join(f"WHEN m RLIKE r'^(?:{pattern})$' THEN '{name}'" for name, pattern in KINDS.items() if name != "card") + " ELSE 'card'"
    new = " ".join(f"WHEN '{name}' THEN {getattr(permuter, name)()}" for name in KINDS if name != "card")
    hit = let("k", f"CASE {kind} END", f"if(k = 'card', {permuter.card_hit()}, {hit_of('k', f'CASE k {new} END')})")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column of the input clashes
    digest = docs.sparkSession.createDataFrame([(hashlib.sha256(key.encode()).hexdigest(),)], "secret string")
    text = F.col(names[text_col])
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), digest.scalar().alias("secret"))
    rows = rows.withColumn("old", F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    rows = rows.withColumn("hits", F.when(F.size("old") > 0, F.expr(f"transform(old, m -> {hit})")))
    rows = rows.withColumn("gaps", F.when(F.size("old") > 0, F.split(text, PATTERN)))
    whole = F.expr("array_join(transform(gaps, (g, i) -> concat(g, coalesce(get(hits, i).new, get(hits, i).old, ''))), '')")
    before = totals_before(F.expr("transform(hits, (h, i) -> length(get(gaps, i)) + length(h.old))"))

    def span(at: Column, h: Column, i: Column, part: Column) -> Column:
        start = (F.get(at, i) + F.length(F.get("gaps", i)) + part["at"]).cast("int")
        return F.struct(h["kind"].alias("kind"), start.alias("start"), (start + part["size"]).alias("end"), part["valid"].alias("was_valid"))

    spans = bound(before, lambda at: F.flatten(F.transform("hits", lambda h, i: F.transform(h["parts"], lambda p: span(at, h, i, p)))))
    found, none = F.col("hits").isNotNull(), F.array().cast("array<struct<kind:string,start:int,end:int,was_valid:boolean>>")
    rows = rows.withColumns({"new": F.when(found, whole).otherwise(text), "spans": F.when(found, spans).otherwise(none)})
    out = names | {text_col: "new", "pii": "spans"}
    return rows.select(*(F.col(n).alias(c) for c, n in out.items()))


def count_of(kind: str) -> Column:
    """How many valid values of a kind a row of `pseudonymise` had."""
    return F.expr(f"cast(size(filter(pii, s -> s.kind = '{kind}' AND s.was_valid)) AS bigint)")

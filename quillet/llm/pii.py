"""Operator 9, surrogates for personal data and secrets. Built-in functions only.

One pattern finds all entities; the text between them is kept as it is. Each entity is replaced
by a keyed surrogate of its own type and format:

* numbers (phones, cards, social security numbers, accounts) pass a keyed Feistel network over
  their digits, a permutation of the digit strings of one length, and keep their punctuation, so
  the same number written in two ways stays the same number; a phone keeps its country's code
  (by the telephone union's lengths, after + or 00) or its leading 0; the letters of an account, but for
  the country's, are shifted by a key that depends on its digits and the letters before; check
  digits of cards and accounts are those of the new number where they were of the old;
* addresses of the Internet protocol (both versions) pass a keyed permutation of each byte, or
  group, that depends on those before it, inside their class: private, loopback, link-local,
  multicast and public ones stay such; of version 6 the first group, which says the class, is kept;
* e-mail addresses, secrets and names get keyed digests spelled in their own script. A value
  after ``password=`` or the like is a secret where it has a digit. Given and
  family names are keyed apart, so a family keeps its name under any title; the given name has
  the gender that its title says or, under titles without one, that the same given name mostly has
  in the corpus. Where a text names a person with a title, mentions of that name, or of its parts,
  without one are replaced too. Phrases that introduce a person (``my name is``) count as titles;
  names that stand nowhere after one or a title are not found.

Permutations keep different entities apart by construction; for digests the operator checks the
corpus and spells those that meet out at greater length. Equal entities get equal surrogates
everywhere, so references across documents hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.text import let
from quillet.llm.common import join_hot, table

#: Types with their patterns; an entity has the first type that fits.
_TITLES_M = r"Mr|Sir|Herr|Monsieur|Señor|[Κκ]ύριος|[Κκ]ος|[Гг]осподин|г-н"
_TITLES_F = r"Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Señora|[Κκ]υρία|[Κκ]α|[Гг]оспожа|г-жа"
#: Phrases that introduce a person, in five languages; they stand for a title that says no gender.
_INTRO = r"[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m'appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es|[Μμ]ε λένε|[Мм]еня зовут"
_INTRODUCED = rf"(?:{_INTRO})(?= (?!(?:{_TITLES_M}|{_TITLES_F}|Dr|Prof)[. ]))"
_HEAD = rf"\A({_INTRO}|[\p{{L}}-]+\.?) "
#: Names of a secret value, with its sign and quote; values that are secrets by themselves stand alone.
_ASSIGNED = r"(?:[Pp]ass(?:word|wd|phrase)|PASSWORD|[Pp]wd|(?:[Cc]lient[_-])?[Ss]ecret(?:[_-][Kk]ey)?|[Aa]pi[_-]?[Kk]ey|API_KEY|(?:[Aa]ccess[_-]|[Aa]uth[_-])?[Tt]oken)(?: ?= ?|: ?)[\"']?"
_PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\s{0,2}"
_MARKED = r"AKIA|ASIA|(?:sk|pk|rk)[-_]|gh[pousr]_|eyJ|xox[abeprs]-|AIza"
#: Countries whose account numbers have letters or digits, by the number's whole length.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR",
    27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(
    rf"(?:{countries})[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{n // 4 - 1}}}" + (rf" ?[0-9A-Z]{{{n % 4}}}" if n % 4 else "") + "(?![0-9A-Za-z])"
    for n, countries in _IBAN_LENGTHS.items()
)
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "secret": r"(?<![0-9A-Za-z])(?:(?:[0-9a-f]{32,}+|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}+)(?![0-9A-Za-z])|(?:sk|pk|rk)[-_][0-9A-Za-z_-]{16,}+|eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]*+|xox[abeprs]-[0-9A-Za-z-]{10,}+|AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-]))"
    + rf"|(?<![0-9A-Za-z]){_ASSIGNED}(?!{_MARKED}|[0-9a-f]{{32}})(?=[^\s\"'<>,;&]{{0,127}}[0-9])[^\s\"'<>,;&]{{6,128}}+"
    + rf"|{_PRIVATE_KEY}[0-9A-Za-z+/=]{{40,}}+(?:\s{{1,2}}[0-9A-Za-z+/=]{{40,}}+)*+(?:\s{{1,2}}[0-9A-Za-z+/=]++(?=\s{{0,2}}-----END|\z))?",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]{{4}}){{3,7}}(?: ?[0-9]{{1,3}})?(?![0-9A-Za-z]))",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?:[0-9]{3})?(?![0-9])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9])00[1-9][0-9]{0,2}[ .-]\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])0[1-9][0-9]{1,3}[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
    r"|(?<=(?:[Pp]hone|[Tt]el|[Cc]all|[Mm]obile|[Cc]ell|[Ff]ax)[:. ]{1,2})[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:{_TITLES_M}|{_TITLES_F}|Dr|Prof|{_INTRODUCED})\.? \p{{Lu}}[\p{{L}}'-]++(?: \p{{Lu}}[\p{{L}}'-]++)?",
}
_NUMERIC = "|".join(f"(?:{TYPES[t]})" for t in ("ip", "ssn", "card", "phone"))
PATTERN = "|".join(f"(?:{TYPES[t]})" for t in ("email", "secret", "iban")) + f"|(?=[0-9A-Fa-f:])(?:{TYPES['ip6']})|(?=[+(0-9])(?:{_NUMERIC})|(?:{TYPES['name']})"
#: Codes of countries by the telephone union's plan: one, two or three digits.
_COUNTRY = r"\A(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
#: Two names after a title that says no gender.
_UNGENDERED = rf"(?<!\p{{L}})(?:Dr|Prof|{_INTRODUCED})\.? \p{{Lu}}[\p{{L}}'-]++ \p{{Lu}}[\p{{L}}'-]"

#: Given names by gender, in Latin, Greek and Cyrillic script.
_GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Hugo", "Jonas"],
    ("latin", "f"): ["Alice", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Laura"],
    ("greek", "m"): ["Αλέξης", "Γιώργος", "Δημήτρης", "Νίκος"],
    ("greek", "f"): ["Άννα", "Ελένη", "Μαρία", "Σοφία"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Иван", "Павел"],
    ("cyrillic", "f"): ["Анна", "Елена", "Мария", "Ольга"],
}
#: Sixteen syllables of each script, one for each hexadecimal digit.
_SYLLABLES = {
    "latin": "ba be bi bo da de di do la le li lo ma me mi mo".split(),
    "greek": "βα βε βι βο δα δε δι δο λα λε λι λο μα με μι μο".split(),
    "cyrillic": "ба бе би бо да де ди до ла ле ли ло ма ме ми мо".split(),
}


def _type(e: Column) -> Column:
    """The entity's type: the first whose pattern fits it whole."""
    return F.coalesce(*(F.when(e.rlike(rf"\A(?:{p})\z"), F.lit(t)) for t, p in TYPES.items()), F.lit("phone"))


def _digest(key: str, kind: str, value: Column, n: int = 64) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{key}|{kind}|"), value), 256), 1, n)


def _number(key: str, kind: str, value: Column) -> Column:
    """A keyed number under 2**48 from a string."""
    return F.conv(_digest(key, kind, value, 12), 16, 10).cast("long")


def _luhn(digits: Column) -> Column:
    """The check digit of a card's other digits."""
    each = F.transform(
        F.reverse(F.split(digits, "")),
        lambda d, i: F.when(i % 2 == 1, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.pmod(-F.aggregate(each, F.lit(0), lambda a, b: a + b), F.lit(10)).cast("int")


def _mod_97(account: Column) -> Column:
    """An account's number, the country's first four characters put last, modulo 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    of = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda n, c: F.pmod(n * F.when(c.rlike("[0-9]"), 10).otherwise(100) + of(c), F.lit(97)).cast("int"))


def _country(x: Column) -> Column:
    """The country's code of a phone that has one, else no text."""
    value, digits = x["value"], x["digits"]
    abroad = F.when(F.startswith(value, F.lit("+")), digits).when(F.startswith(value, F.lit("00")), F.substring(digits, F.lit(3), F.length(digits)))
    return F.when(x["type"] == "phone", F.coalesce(F.regexp_extract(abroad, _COUNTRY, 1), F.lit(""))).otherwise("")


def _permuted(key: str, items: Column) -> Column:
    """Entities (structs with ``value``, ``digits`` and ``type``) with their digits passed through
    four rounds of a Feistel network, a stage each, so that no round is computed twice. A phone's
    leading zeros and its country's code stay, and the code keys the rest. The last digit of a card is no part of it: it keeps its distance from the right check digit."""
    same = ("value", "type", "head", "salt", "n", "h0", "h1")

    def coded(x: Column) -> Column:
        zeros = F.when(x["type"] == "phone", F.length(F.regexp_extract(x["value"], r"\A0{0,2}", 0))).otherwise(0)
        return F.struct(x["value"].alias("value"), x["type"].alias("type"), x["digits"].alias("digits"), _country(x).alias("code"), zeros.alias("zeros"))

    def halves(x: Column) -> Column:
        whole = F.length(x["digits"])
        kept = x["zeros"] + F.length(x["code"])
        n = whole - kept - F.when(x["type"] == "card", 1).otherwise(0)
        u = F.floor(n / 2).cast("int")
        off = F.when(x["type"] == "card", F.substring(x["digits"], whole, F.lit(1)).cast("int") - _luhn(F.substring(x["digits"], F.lit(1), n)))
        return F.struct(
            x["value"].alias("value"), x["type"].alias("type"), F.substring(x["digits"], F.lit(1), kept).alias("head"), F.concat(n.cast("string"), F.lit("+"), x["code"], F.lit(":")).alias("salt"),
            n.alias("n"), F.substring(x["digits"], kept + 1, u).alias("h0"), F.substring(x["digits"], kept + u + 1, n - u).alias("h1"), off.alias("off"),
        )

    def turned(r: int):
        side, other = f"h{r % 2}", f"h{1 - r % 2}"

        def turn(x: Column) -> Column:
            salted = F.concat(x["salt"], x[other])
            whole = F.rpad(F.lit("1"), F.length(x[side]) + 1, F.lit("0")).cast("decimal(20,0)")
            moved = F.pmod(x[side].cast("decimal(20,0)") + _number(key, f"digits{r}", salted), whole).cast("decimal(20,0)").cast("string")
            new = F.when(x[side] == "", x[side]).otherwise(F.lpad(moved, F.length(x[side]), F.lit("0")))
            return F.struct(*(new.alias(c) if c == side else x[c].alias(c) for c in same), x["off"].alias("off"))

        return turn

    def last(x: Column) -> Column:
        both = F.concat(x["head"], x["h0"], x["h1"])
        return F.when(x["type"] == "card", F.concat(both, F.pmod(_luhn(both) + x["off"], F.lit(10)).cast("string"))).otherwise(both)

    items = F.transform(F.transform(items, coded), halves)
    for r in range(4):
        items = F.transform(items, turned(r))
    return F.transform(items, lambda x: F.when(x["n"] > 0, _refilled(x["value"], last(x))).otherwise(x["value"]))


def _digits_of(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _refilled(e: Column, digits: Column) -> Column:
    """Put new digits in the places of the old ones."""
    places = F.transform(
        F.sequence(F.lit(1), F.length(e)),
        lambda i: F.when(
            F.substring(e, i, F.lit(1)).rlike("[0-9]"),
            F.substring(digits, F.length(_digits_of(F.substring(e, F.lit(1), i))), F.lit(1)),
        ).otherwise(F.substring(e, i, F.lit(1))),
    )
    return F.array_join(places, "")


def _ip(key: str, e: Column) -> Column:
    """Each byte permuted by a key that depends on those before it, inside the address's class."""
    x = [F.get(F.split(e, r"\."), i).cast("long") for i in range(4)]
    before = [F.substring_index(e, ".", i) for i in range(4)]
    add = [_number(key, "ip+", b) for b in before]
    free = [F.pmod(v * (2 * F.pmod(_number(key, "ip*", b), F.lit(128)) + 1) + k, F.lit(256)) for v, b, k in zip(x, before, add)]
    #: first bytes of which no part has a class of its own
    plain = F.array_except(F.sequence(F.lit(1), F.lit(223)), F.array(*map(F.lit, (10, 127, 169, 172, 192))))
    place = F.array_position(plain, x[0].cast("int"))
    first = F.when(place == 0, x[0]).otherwise(F.element_at(plain, (F.pmod(place - 1 + add[0], F.lit(218)) + 1).cast("int")).cast("long"))

    def around(low: int, n: int) -> Column:
        """The second byte, inside ``low`` and the n - 1 after it or outside of them."""
        gap = F.when(x[1] >= low, n).otherwise(0)
        moved = F.pmod(x[1] - gap + add[1], F.lit(256 - n))
        inside = F.pmod(x[1] - low + add[1], F.lit(n)) + low
        return F.when(x[1].between(low, low + n - 1), inside).otherwise(moved + F.when(moved >= low, n).otherwise(0))

    second = F.when(x[0] == 172, around(16, 16)).when(x[0] == 192, around(168, 1)).when(x[0] == 169, around(254, 1)).otherwise(free[1])
    return F.concat_ws(".", first.cast("string"), second.cast("string"), free[2].cast("string"), free[3].cast("string"))


def _ip6(key: str, e: Column) -> Column:
    """Each group but the first shifted by a key that depends on the groups before, its length
    kept; ``::1`` stays."""
    parts = F.split(e, ":")

    def group(g: Column, i: Column) -> Column:
        shift = _number(key, "ip6", F.concat(F.length(g).cast("string"), F.lit(":"), F.lower(F.array_join(F.slice(parts, F.lit(1), i), ":"))))
        whole = F.element_at(F.array(*(F.lit(16**n) for n in range(1, 5))), F.length(g))
        moved = F.lower(F.conv(F.pmod(F.conv(g, 16, 10).cast("long") + shift, whole).cast("string"), 10, 16))
        return F.when((g == "") | (i == 0) | (e == "::1"), g).otherwise(F.lpad(moved, F.length(g), F.lit("0")))

    return F.array_join(F.transform(parts, group), ":")


def _domain(key: str, domain: Column, longer: int) -> Column:
    return F.concat(F.lit("host"), _digest(key, "domain", domain, 8 + longer), F.lit(".example.org"))


def _email(key: str, e: Column, longer: int) -> Column:
    low = F.lower(e)
    return F.concat(F.lit("u"), _digest(key, "mail", low, 10 + longer), F.lit("@"), _domain(key, F.substring_index(low, "@", -1), longer))


def _account(key: str, e: Column, numbers: Column) -> Column:
    """``numbers`` (the account ``e`` with new digits) with its letters, the country's apart, shifted."""
    tail = F.substring(numbers, F.lit(3), F.length(numbers))
    letters = F.regexp_replace(tail, "[^A-Z]", "")

    def at(i: Column) -> Column:
        c = F.substring(tail, i, F.lit(1))
        before = F.regexp_replace(F.substring(tail, F.lit(1), i - 1), "[^A-Z]", "")
        shift = _number(key, "account", F.concat(F.substring(e, 1, 2), _digits_of(e), F.lit(":"), before))
        moved = F.pmod(F.ascii(c) - 65 + shift, F.lit(26)).cast("int") + 1
        return F.when(c.rlike("[A-Z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), moved, F.lit(1))).otherwise(c)

    shifted = F.concat(F.substring(numbers, 1, 2), F.array_join(F.transform(F.sequence(F.lit(1), F.length(tail)), at), ""))

    def checked(new: Column) -> Column:
        rest = F.substring(new, F.lit(5), F.length(new))
        open_ = F.concat(F.substring(new, 1, 2), F.lit("00"), rest)
        check = F.lpad((98 - _mod_97(open_)).cast("string"), 2, "0")
        return F.when(_mod_97(e) == 1, F.concat(F.substring(new, 1, 2), check, rest)).otherwise(new)

    return let(F.when(letters == "", numbers).otherwise(shifted), checked)


def _secret(key: str, e: Column, longer: int) -> Column:
    """Same prefix, same length, the dots of a token in place; all else from keyed digests, others
    for each value of ``longer``. Values after a name have 16 digits at least."""
    prefix = F.regexp_extract(e, rf"\A({_MARKED}|{_PRIVATE_KEY}|{_ASSIGNED})", 1)
    turn = f"+{longer}" if longer else ""

    def parted(prefix: Column) -> Column:
        rest, assigned = F.substring(e, F.length(prefix) + 1, F.length(e)), prefix.rlike("[=:]")
        size = F.when(assigned, F.greatest(F.length(rest), F.lit(16))).otherwise(F.length(rest))
        seed = _digest(key, f"secret{turn}", F.when(assigned, rest).otherwise(e))
        return F.struct(prefix.alias("prefix"), rest.alias("rest"), size.alias("size"), seed.alias("seed"))

    def spelled(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(x["size"] / 64)), lambda i: F.sha2(F.concat(x["seed"], i.cast("string")), 256))
        return F.struct(x["prefix"].alias("prefix"), x["rest"].alias("rest"), F.substring(F.array_join(blocks, ""), F.lit(1), x["size"]).alias("body"))

    def whole(x: Column) -> Column:
        ends = F.transform(F.split(x["rest"], r"\."), lambda p: F.length(p))
        upto = lambda i: F.aggregate(F.slice(ends, F.lit(1), i), F.lit(0), lambda a, b: a + b)
        dotted = F.array_join(F.transform(ends, lambda n, i: F.substring(x["body"], upto(i) + 1, n)), ".")
        return F.concat(x["prefix"], F.when(x["prefix"].isin("AKIA", "ASIA"), F.upper(x["body"])).when(x["prefix"] == "eyJ", dotted).otherwise(x["body"]))

    steps = F.array(prefix)
    for step in (parted, spelled, whole):
        steps = F.transform(steps, step)
    return F.get(steps, 0)


def _title(e: Column) -> Column:
    return F.regexp_extract(e, _HEAD, 1)


def _gender(title: Column) -> Column:
    """f, m, or null where the title does not say."""
    return F.when(title.rlike(rf"\A(?:{_TITLES_F})\.?\z"), "f").when(title.rlike(rf"\A(?:{_TITLES_M})\.?\z"), "m")


def _spelled(digest: Column, script: Column) -> Column:
    """A digest in syllables of a script."""
    return F.coalesce(
        *(
            F.when(script == s, F.array_join(F.transform(F.split(digest, ""), lambda h: F.element_at(F.array(*map(F.lit, syllables)), F.conv(h, 16, 10).cast("int") + 1)), ""))
            for s, syllables in _SYLLABLES.items()
        )
    )


def _name(key: str, e: Column, longer: int, genders: Column) -> Column:
    """Title, given name (if there are two names) and family name, each name from its own key."""

    def parted(title: Column) -> Column:
        rest = F.substring(e, F.length(title) + 2, F.length(e))
        script = F.when(rest.rlike(r"\p{IsGreek}"), "greek").when(rest.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        first = F.substring_index(rest, " ", 1)
        return F.struct(title.alias("title"), rest.alias("rest"), script.alias("script"), first.alias("first"), F.substring_index(rest, " ", -1).alias("last"), _number(key, "given", first).alias("pick"))

    def whole(x: Column) -> Column:
        by_key = F.when(F.pmod(x["pick"], F.lit(2)) == 0, "f").otherwise("m")
        chosen = F.concat(x["script"], F.coalesce(_gender(x["title"]), F.element_at(genders, x["first"]), by_key))
        given = F.coalesce(
            *(F.when(chosen == s + g, F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.floor(x["pick"] / 2), F.lit(len(names))) + 1).cast("int"))) for (s, g), names in _GIVEN.items())
        )
        given = F.concat(given, _spelled(_digest(key, "first", x["first"], 4 + longer), x["script"]))
        family = let(_spelled(_digest(key, "family", x["last"], 10 + longer), x["script"]), lambda f: F.concat(F.upper(F.substring(f, 1, 1)), F.substring(f, F.lit(2), F.length(f))))
        return F.concat(x["title"], F.lit(" "), F.when(x["rest"].contains(" "), F.concat(given, F.lit(" "))).otherwise(""), family)

    return let(let(_title(e), parted), whole)


def _no_genders() -> Column:
    return F.create_map().cast("map<string,string>")


def surrogates(key: str, found: Column, longer: int = 0, genders: Column | None = None) -> Column:
    """The surrogates of an array of entities; ``longer`` lengthens those made from digests.
    ``genders``: f or m of given names, for titles that do not say. Whatever an expression names more than once is a value
    of its own (``let``), since each naming is a copy in the plan, and the driver holds the plan."""
    typed = F.transform(found, lambda e: F.struct(e.alias("value"), _type(e).alias("type")))
    digits = lambda x: F.when(x["type"].isin("phone", "card", "ssn", "iban"), _digits_of(x["value"])).otherwise("")
    numbers = _permuted(key, F.transform(typed, lambda x: F.struct(x["value"].alias("value"), x["type"].alias("type"), digits(x).alias("digits"))))
    return F.zip_with(
        typed, numbers,
        lambda x, number: F.when(x["type"] == "email", _email(key, x["value"], longer))
        .when(x["type"] == "secret", _secret(key, x["value"], longer))
        .when(x["type"] == "iban", _account(key, x["value"], number))
        .when(x["type"] == "ip", _ip(key, x["value"]))
        .when(x["type"] == "ip6", _ip6(key, x["value"]))
        .when(x["type"] == "name", _name(key, x["value"], longer, genders if genders is not None else _no_genders()))
        .otherwise(number),
    )


def found_in(text: Column) -> Column:
    """All entities of a text, in order. Texts that hold nothing an entity needs are passed by."""
    any_ = F.rlike(text, F.lit("[0-9@]")) | F.rlike(text, F.lit(r"(?:AKIA|ASIA|[spr]k[-_]|gh[pousr]_)[0-9A-Za-z_-]{16}|eyJ|[a-f]{32}|xox[abeprs]-|AIza|-----BEGIN")) | F.rlike(text, F.lit(TYPES["name"]))
    return F.when(any_, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _canonical(e: Column, kind: Column) -> Column:
    """One spelling for each entity of a type: digits of numbers, lower-case addresses."""
    return F.when(kind.isin("email", "ip6"), F.lower(e)).when(kind.isin("phone", "card", "ssn"), _digits_of(e)).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).otherwise(e)


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, place (from 0), type and value of each entity."""
    found = docs.select("doc_id", F.posexplode(found_in(F.coalesce("text", F.lit("")))).alias("place", "value"))
    return found.withColumn("type", _type(F.col("value")))


def meets(docs: DataFrame, key: str, longer: int = 0) -> DataFrame:
    """The collision check: surrogates that stand for more than one entity of the corpus."""
    values = entities(docs).where("type IN ('email', 'secret', 'name', 'iban')").select("type", "value").distinct()
    domain = F.lower(F.substring_index("value", "@", -1))
    told = lambda kind, entity, new: F.struct(kind.alias("type"), entity.alias("entity"), new.alias("surrogate"))
    own = told(F.col("type"), _canonical(F.col("value"), F.col("type")), F.get(surrogates(key, F.array("value"), longer), 0))
    both = F.array_compact(F.array(own, F.when(F.col("type") == "email", told(F.lit("domain"), domain, _domain(key, domain, longer)))))
    return values.select(F.inline(both)).groupBy("type", "surrogate").agg(F.count_distinct("entity").alias("n")).where("n > 1")


def _mentions(found: Column, new: Column) -> Column:
    """Names that a text has with a title, and the parts of those of two words, each with what
    stands for it in the surrogate; longer ones first."""
    both = F.filter(F.arrays_zip(found.alias("old"), new.alias("new")), lambda x: x["old"].rlike(rf"\A(?:{TYPES['name']})\z"))
    both = F.transform(both, lambda x: F.struct(*(F.regexp_replace(x[c], _HEAD, "").alias(c) for c in ("old", "new"))))
    part = lambda n: F.transform(both, lambda x: F.struct(*(F.substring_index(x[c], " ", n).alias(c) for c in ("old", "new"))))
    sized = F.transform(F.concat(both, part(-1), part(1)), lambda x: F.struct((-F.length(x["old"])).alias("n"), x["old"].alias("old"), x["new"].alias("new")))
    return F.array_sort(F.array_distinct(sized))


def _unnamed(text: Column, mentions: Column) -> Column:
    """A text between entities with the mentions replaced."""
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.transform(mentions, lambda m: F.concat(F.lit(r"\Q"), m["old"], F.lit(r"\E"))), "|"), F.lit(r")(?!\p{L})"))
    new = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda e: F.get(F.filter(mentions, lambda m: m["old"] == e), 0)["new"])
    replaced = F.array_join(F.zip_with(F.split(text, pattern, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.size(mentions) > 0, replaced).otherwise(text)


def genders(docs: DataFrame) -> DataFrame:
    """``given`` and ``gender``, the one that a given name mostly has under titles that say one."""
    named = docs.select(F.explode(found_in(F.coalesce("text", F.lit("")))).alias("e")).where(F.col("e").rlike(rf"\A(?:{_TITLES_M}|{_TITLES_F})\.? [^ ]+ "))
    given = F.substring_index(F.regexp_replace("e", _HEAD, ""), " ", 1)
    counts = named.select(given.alias("given"), F.when(_gender(_title(F.col("e"))) == "f", 1).otherwise(-1).alias("f")).groupBy("given").agg(F.sum("f").alias("f"))
    return counts.where("f <> 0").select("given", F.when(F.col("f") > 0, "f").otherwise("m").alias("gender"))


def _with_genders(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds ``genders__``: the genders that the corpus knows of given names under other titles."""
    keyed = docs.withColumn("text__", F.md5(F.col("text").cast("binary")))
    asked = F.transform(F.regexp_extract_all("text", F.lit(_UNGENDERED), F.lit(0)), lambda e: F.substring_index(F.regexp_replace(e, _HEAD, ""), " ", 1))
    wanted = keyed.select("text__", F.explode(asked).alias("given")).distinct()
    known = wanted.join(genders(corpus), "given").groupBy("text__").agg(F.map_from_entries(F.collect_list(F.struct("given", "gender"))).alias("genders__"))
    return join_hot(keyed, known, "text__", "left").drop("text__").withColumn("genders__", F.coalesce("genders__", _no_genders()))


def _replaced(docs: DataFrame, key: str, longer: int) -> DataFrame:
    with_found = docs.withColumn("found__", found_in(F.coalesce("text", F.lit(""))))
    with_new = with_found.withColumn("new__", F.when(F.size("found__") > 0, surrogates(key, F.col("found__"), longer, F.col("genders__"))))
    with_new = with_new.withColumn("names__", F.when(F.size("found__") > 0, _mentions(F.col("found__"), F.col("new__"))))
    pieces = F.zip_with(F.split("text", PATTERN, -1), "new__", lambda a, b: F.concat(_unnamed(a, F.col("names__")), F.coalesce(b, F.lit(""))))
    replaced = F.when(F.col("new__").isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text"))
    return with_new.withColumns({"text": replaced, "n_entities": F.size("found__").cast("long")}).drop("found__", "new__", "names__", "genders__")


def replace_entities(docs: DataFrame, key: str, check: bool = True) -> DataFrame:
    """``docs`` with each entity in ``text`` replaced, and n_entities.

    Null texts stay null, with no entities; text outside entities is untouched; repeated rows are
    replaced alike; other columns are kept, an n_entities column is replaced. Names without a
    title are replaced, and not counted, in texts that have them with one. With ``check`` the
    corpus is searched for surrogates that meet, and digests are lengthened until none do; where
    some still meet at the greatest length, the job fails.
    """
    longer = 0
    while check and not (met := meets(docs, key, longer)).isEmpty():
        if longer == 40:
            raise ValueError(f"surrogates that stand for several entities: {[tuple(r) for r in met.limit(5).collect()]}")
        longer += 10
    # a row travels as one column, so that no name of a helper column can clash with its own
    docs = docs.drop("n_entities").select(F.struct("*").alias("row"), "text")
    unsaid = F.coalesce(F.col("text").rlike(_UNGENDERED), F.lit(False))
    none = docs.where(unsaid).isEmpty()
    out = _replaced((docs if none else docs.where(~unsaid)).withColumn("genders__", _no_genders()), key, longer)
    if not none:
        out = out.unionByName(_replaced(_with_genders(docs.where(unsaid), docs), key, longer))
    return out.select(F.col("row").withField("text", F.col("text")).alias("row"), "n_entities").select("row.*", "n_entities")


#: The pipeline's and the query's key; a deployment passes its own.
KEY = "quillet"


def op9(spark, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data and secrets."""
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)

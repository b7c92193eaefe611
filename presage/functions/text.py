"""Text functions as Column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "(missing)"

# Report item codes and the theme each stands for; the first known item of a report wins.
THEMES = {
    "2.02": "earnings",
    "2.01": "M&A",
    "1.01": "material agreement",
    "1.02": "material agreement",
    "5.02": "management change",
    "7.01": "guidance / RegFD",
    "8.01": "other material news",
    "2.05": "restructuring",
    "2.06": "restructuring",
    "4.01": "auditor change",
    "4.02": "restatement",
    "3.01": "listing / compliance",
    "5.07": "shareholder vote",
    "1.03": "bankruptcy",
    "2.03": "new debt / financing",
    "2.04": "debt trigger",
    "3.02": "equity issuance",
}
# Items of administration, never a theme.
ADMINISTRATIVE = ["9.01", "5.03", "5.05", "8.03"]


def items(text: Column) -> Column:
    """The trimmed, nonempty parts of a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def theme(text: Column) -> Column:
    """The theme of the first known item; `other` if only unknown ones, else `exhibits only`."""
    table = F.create_map(*[F.lit(x) for kv in THEMES.items() for x in kv])
    telling = F.filter(items(text), lambda x: ~x.isin(ADMINISTRATIVE))
    known = F.filter(telling, lambda x: F.map_contains_key(table, x))
    return (
        F.when(F.size(known) > 0, F.try_element_at(table, F.try_element_at(known, F.lit(1))))
        .when(F.size(telling) > 0, "other")
        .otherwise("exhibits only")
    )


def smart_title(name: Column) -> Column:
    """Capital-only names in title case with small and, of, the; other names as they are."""
    words = F.split(F.initcap(F.lower(name)), " +")
    small = F.transform(words, lambda w: F.when(F.lower(w).isin("and", "of", "the"), F.lower(w)).otherwise(w))
    shout = (F.upper(name) == name) & (F.lower(name) != name)
    return F.when(shout, F.array_join(F.filter(small, lambda w: w != ""), " ")).otherwise(name)


def without_footnotes(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\[[^\]\n]*\]", ""))


def date_of(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy")) -> Column:
    """The date under the first format that fits, else null."""
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def category(value: Column) -> Column:
    """The value as a category: null and empty are a category of their own."""
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(MISSING))


def label(field: str, value: Column) -> Column:
    """`field = value`; a number without decimals as an integer, text as it is."""
    said = value.cast("string")
    number = F.when(F.rlike(said, F.lit(r"^-?\d+(\.0|\.\d+E\d+)$")), said.try_cast("double"))
    whole = F.when(number == F.floor(number), number.cast("bigint").cast("string"))
    return F.concat(F.lit(f"{field} = "), F.coalesce(whole, said))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {NAME} replaced by its value as text; a null value fills in nothing."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def columns_like(names: list[str], *parts: str) -> list[str]:
    """The columns whose names hold one of the parts, in any case, in order; a name that repeats comes once."""
    found = [n for n in names if any(p.lower() in n.lower() for p in parts)]
    return list(dict.fromkeys(found))


def fold_of(key: Column, k: int = 5) -> Column:
    """The MD5 of key as a number, modulo k, for the k that divide 15 (5, 3).

    16 is 1 modulo such a k, so the number is its digits' sum, in parts of any
    length: two of 15 digits and one of 2.
    """
    if 15 % k:
        raise ValueError("16 must be 1 modulo k")
    digest = F.md5(key)
    parts = [F.conv(F.substring(digest, at, n), 16, 10).cast("bigint") % k for at, n in ((1, 15), (16, 15), (31, 2))]
    return ((parts[0] + parts[1] + parts[2]) % k).cast("string")


#: An entity behind its ampersand; what browsers take numbers 128 to 159 for.
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
WINDOWS = [bytes([b]).decode("cp1252", "replace") for b in range(128, 160)]


def unescaped(text: Column) -> Column:
    """The text with its named and numbered entities read, each once; what is none stays."""
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))])

    def read(part: Column) -> Column:
        said = F.regexp_extract(part, ENTITY, 1)
        number = F.when(F.rlike(said, F.lit("^#[0-9]")), F.substring(said, 2, 9)).when(F.rlike(said, F.lit("^#[xX]")), F.conv(F.substring(said, 3, 9), 16, 10)).cast("int")
        wrong = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        char = F.when(wrong, "\ufffd").when(number.between(128, 159), F.try_element_at(F.array(*[F.lit(c) for c in WINDOWS]), number - 127))
        char = char.otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        value = F.when(number.isNotNull(), char).when(said != "", F.try_element_at(names, said))
        return F.coalesce(F.concat(value, F.substring(part, F.char_length(said) + 2, F.char_length(part))), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), read), ""))


def unescaped_sql(text: str) -> str:
    """unescaped() of an SQL expression."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    names = "map {" + ", ".join(f"{quoted(n)}: {quoted(chr(c))}" for n, c in sorted(name2codepoint.items())) + "}"
    said = f"regexp_extract(p, '{ENTITY}', 1)"
    number = f"case when regexp_matches({said}, '^#[0-9]') then cast(substr({said}, 2) as int) when regexp_matches({said}, '^#[xX]') then cast(concat('0x', substr({said}, 3)) as int) end"
    windows = "[" + ", ".join(quoted(c) for c in WINDOWS) + "]"
    char = f"case when ({number}) = 0 or ({number}) > 1114111 or ({number}) between 55296 and 57343 then chr(65533) when ({number}) between 128 and 159 then {windows}[({number}) - 127] else chr({number}) end"
    value = f"case when ({number}) is not null then {char} when {said} <> '' then {names}[{said}] end"
    read = f"coalesce({value} || substr(p, length({said}) + 2), '&' || p)"
    return f"concat(string_split({text}, '&')[1], array_to_string(list_transform(string_split({text}, '&')[2:], lambda p: {read}), ''))"


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts and styles go, tags become line ends, five entities are read, runs of blank shrink."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", "\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r"\n\s*\n\s*\n+", "\n\n"))


# Words that tell of bad and of good news.
BAD = ["miss", "below expectations", "decline", "lower", "cut guidance", "disappoint"]
GOOD = ["record", "beat", "raise", "exceeded", "strong", "growth"]
# Words that settle a signal of a press release, first come first served, and what it is without any.
SIGNALS = {
    "reported_beat": ([(["miss"], "miss"), (["beat"], "beat")], "not_stated"),
    "guidance": ([(["lower", "cut"], "lowered"), (["raise"], "raised")], "none"),
    "revenue_direction": ([(["record revenue", "revenue grew"], "up")], "not_stated"),
    "one_time_items": ([(["charge", "impairment"], "charges")], "none"),
}
# Predictions by rule, likeliest first.
RULED = {
    "down": [("down", 0.55), ("flat", 0.28), ("up", 0.17)],
    "up": [("up", 0.5), ("flat", 0.28), ("down", 0.22)],
    "flat": [("flat", 0.4), ("up", 0.32), ("down", 0.28)],
}
# Parts of the file names of press releases and of commentaries.
RELEASE_NAMES = ["pr.htm", "press", "ex99", "ex-99", "earnings", "release", "results"]
COMMENTARY_NAMES = ["commentary", "cfo"]
# Sections of reports as characters to skip and to take, where the text is long enough; headers as patterns.
BODY, MDA, MDA_FROM, ANNUAL_HEAD, PROXY_HEAD = (9_000, 8_000, 42_000), (90_000, 80_000, 30_000), 50_000, 40_000, 30_000
MDA_HEADER = r"(?im)^\s*management.s\s+discussion\s+and\s+analysis"
PAY_HEADER = r"compensation\s+discussion\s+and\s+analysis"
PEOPLE_HEADER = r"(?:director|executive\s+officer)s?\s+(?:biographies|of\s+the\s+registrant)"


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def keyword_signals(text: Column) -> dict[str, Column]:
    """Signals of a press release from its words alone."""
    t = F.lower(text)
    bad, good = _any(t, BAD), _any(t, GOOD)

    def settled(name: str) -> Column:
        rules, otherwise = SIGNALS[name]
        return F.coalesce(*[F.when(_any(t, words), F.lit(label)) for words, label in rules], F.when(t.isNotNull(), F.lit(otherwise)), F.lit(otherwise))

    only_bad = F.coalesce(bad & ~good, F.lit(False))
    headline = F.when(only_bad, "clearly_negative").when(good & ~bad, "clearly_positive").otherwise("mixed")
    rest = {"eps_direction": F.when(only_bad, "down").otherwise("up"), "tone": F.when(bad, "cautious").otherwise("confident")}
    return {"headline_signal": headline} | {name: settled(name) for name in SIGNALS} | rest


def rule_prediction(guidance: Column, beat: Column, headline: Column) -> Column:
    """array<struct<bucket, p>>, most likely first: the prediction where no model is at hand."""

    def ranked(name: str) -> Column:
        return F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(p).alias("p")) for b, p in RULED[name]])

    down = (guidance == "lowered") | (beat == "miss") | (headline == "clearly_negative")
    up = (guidance == "raised") | (headline == "clearly_positive")
    return F.when(down, ranked("down")).when(up, ranked("up")).otherwise(ranked("flat"))


def release_rank(name: Column) -> Column:
    """0 for a press release's file name, 1 for commentary, else 2."""
    low = F.lower(name)
    return F.when(_any(low, RELEASE_NAMES), 0).when(_any(low, COMMENTARY_NAMES), 1).otherwise(2)


def annual_sections(text: Column) -> dict[str, Column]:
    """Windows of an annual report: business and risks; management's discussion; else the head."""
    n = F.char_length(text)
    window = lambda w: F.when(n > w[0], F.substring(text, w[1] + 1, w[2]))
    body, late = window(BODY), F.substring(text, F.lit(MDA_FROM + 1), F.greatest(n - MDA_FROM, F.lit(0)))
    anchor = F.regexp_instr(late, F.lit(MDA_HEADER))
    mda = F.coalesce(F.when(anchor > 0, F.substring(late, anchor, F.lit(MDA[2]))), window(MDA))
    return {"business_and_risks": body, "mda": mda, "head": F.when(body.isNull() & mda.isNull(), F.substring(text, 1, ANNUAL_HEAD))}


def last_window(text: Column, pattern: str, size: int = 20_000, least: int = 1_000) -> Column:
    """The text from the pattern's last match on, if there is enough of it."""
    before = F.char_length(text) - F.char_length(F.regexp_replace(text, f"(?is)^.*(?={pattern})", ""))
    body = F.substring(text, before + 1, F.lit(size))
    return F.when(F.regexp_like(text, F.lit(f"(?i){pattern}")) & (F.char_length(body) >= least), body)


def proxy_sections(text: Column) -> dict[str, Column]:
    """The two sections of a proxy statement from their last headers on; else the head."""
    pay, people = last_window(text, PAY_HEADER), last_window(text, PEOPLE_HEADER)
    return {"cd_a": pay, "biographies": people, "head": F.when(pay.isNull() & people.isNull(), F.substring(text, 1, PROXY_HEAD))}


# Fixed value: what stands where a section was cut.
CUT = "\n\n[…section truncated for token budget…]"


def within_budget(sections: dict[str, Column], max_tokens: Column | int, per_token: int = 4, mark: str = "") -> Column:
    """Sections in order as array<struct<name, body>>: all but the largest whole, that one cut to what is left, and marked."""
    budget = (F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens) * per_token
    all_ = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("body")) for k, v in sections.items()]), lambda s: s["body"].isNotNull())
    total = F.aggregate(all_, F.lit(0), lambda acc, s: acc + F.char_length(s["body"]))
    most = F.array_max(F.transform(all_, lambda s: F.char_length(s["body"])))
    # The largest section; of equals the last.
    largest = F.element_at(F.filter(all_, lambda s: F.char_length(s["body"]) == most), -1)["name"]
    left = F.greatest(budget - (total - most), F.lit(0))
    trimmed = F.transform(
        all_,
        lambda s: F.struct(
            s["name"].alias("name"), F.when((total > budget) & (s["name"] == largest), F.concat(F.substring(s["body"], F.lit(1), left), F.lit(mark))).otherwise(s["body"]).alias("body")
        ),
    )
    return F.when(F.size(all_) > 0, trimmed)


def with_banners(kind: str, sections: Column) -> Column:
    return F.array_join(F.transform(sections, lambda s: F.concat(F.lit(f"== {kind} / "), s["name"], F.lit(" ==\n"), F.trim(s["body"]), F.lit("\n"))), "\n")


def combined_excerpt(annual: dict[str, Column], proxy: dict[str, Column], max_tokens: int) -> Column:
    """Sections of an annual report and a proxy statement in one text: three quarters of the budget for the first."""
    parts = [(with_banners("annual", within_budget(annual, max_tokens * 3 // 4))), with_banners("proxy", within_budget(proxy, max_tokens // 4))]
    return F.concat_ws("\n", *parts)

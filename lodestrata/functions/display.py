"""Captured texts as a reader sees them: repaired, without page chrome, as short lists. Column functions throughout."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONTACT_PATTERN, ITEM_PATTERN, MISREADINGS, NO_TEXT, NOT_KNOWN, SHANGHAI_PM, VERIFICATION_LABELS, Profile
from .text import squeeze, strip
from .values import any_word, is_unknown, known, let, no_strings

HAN = r"[\x{4e00}-\x{9fff}]"


def _any(words: tuple[str, ...]) -> str:
    return any_word(words)


def _place(text: Column, pattern: str) -> Column:
    """Where the pattern's first match begins, from 1; 0 for none."""
    return F.regexp_instr(text, F.lit(pattern))


def _from(text: Column, place: Column) -> Column:
    return F.substr(text, F.greatest(place, F.lit(1)))


def repaired(text: Column) -> Column:
    """One line without spaces between ideographs or inside brackets, and with the usual misreadings put right."""

    def joined(line: Column) -> Column:
        out = line
        for _ in range(3):
            out = F.regexp_replace(out, f"({HAN})\\s+({HAN})", "$1$2")
        return F.when(line.rlike(f"{HAN}\\s"), out).otherwise(line)

    out = let(squeeze(text), joined)
    for pattern, right in MISREADINGS:
        word = re.fullmatch(r"\(\?<!\\w\)(\w+)\(\?!\\w\)", pattern)
        if word:  # rare words: the text is looked through for them alone first
            out = let(out, lambda t: F.when(t.contains(word[1]), F.regexp_replace(t, pattern, right)).otherwise(t))
        else:
            out = F.regexp_replace(out, pattern, right)
    return out


def _begun(text: Column, profile: Profile) -> Column:
    """From the first heading; without one from the first item, if what stands before it is page chrome."""
    heading = _place(text, _any(profile.display_headings))
    item = _place(text, rf"(?:^|\s){ITEM_PATTERN}")
    chrome = F.left(text, F.greatest(item - 1, F.lit(0))).rlike(profile.chrome_pattern)
    return F.when(heading > 1, _from(text, heading)).when((item > 1) & chrome, _from(text, item)).otherwise(text)


def _ended(text: Column, profile: Profile) -> Column:
    """Up to the first sign of the page around it or of a contact, if something stands before that."""
    at = F.least(*(F.when(place > 1, place) for place in (*(F.instr(text, m) for m in (*profile.display_noise, *profile.noise_names)), _place(text, CONTACT_PATTERN))))
    return F.coalesce(strip(F.left(text, at - 1)), text)


def display_text(text: Column, profile: Profile = SHANGHAI_PM) -> Column:
    """A captured text for display; empty for what is not known."""
    body = let(repaired(F.coalesce(known(text), F.lit(""))), lambda t: _begun(t, profile))
    body = strip(F.regexp_replace(body, r"[？?]\s*R?\s*$", ""))
    body = F.regexp_replace(body, profile.page_top_pattern, "")
    return strip(F.regexp_replace(let(body, lambda t: _ended(t, profile)), rf"^{_any(profile.leading_headings)}[：:]?\s*", ""))


def display_items(text: Column, profile: Profile = SHANGHAI_PM, most: int = 3, least: int = 4, key: int = 24) -> Column:
    """The first numbered items of a text, distinct by how they begin; the text itself where there are none."""

    def items(body: Column) -> Column:
        parts = F.transform(F.split(body, rf"(?=(?:^|\s){ITEM_PATTERN})"), lambda x: strip(F.regexp_replace(F.regexp_replace(x, rf"^\s*{ITEM_PATTERN}\s*|[？?]\s*$", ""), r"^[\s，。；：:]+", "")))
        parts = F.filter(parts, lambda x: (F.length(x) >= least) & ~x.rlike(r"^[RABC]\s*$"))
        start = lambda x: F.left(F.regexp_replace(x, r"^\d{1,2}[、.)]?\s*", ""), F.lit(key))
        add = lambda kept, x: F.when(F.exists(kept, lambda y: start(y) == start(x)), kept).otherwise(F.concat(kept, F.array(x)))
        return let(F.aggregate(parts, no_strings(), add), lambda kept: F.when(body == "", no_strings()).when(F.size(kept) == 0, F.array(body)).otherwise(F.slice(kept, 1, most)))

    return let(display_text(text, profile), items)


def is_noise(text: Column, profile: Profile = SHANGHAI_PM) -> Column:
    """Nothing, little, or signs of a misread page."""
    return text.isNull() | (F.length(text) < 12) | text.rlike(profile.misread_pattern)


def _last(text: Column, numeral: str, start: tuple[str, ...], stop_numeral: str, stop: tuple[str, ...]) -> Column:
    """What follows the last start heading up to the next stop heading; NULL for nothing."""
    found = F.regexp_extract(text, rf"(?s)^.*(?:{numeral}、)?{_any(start)}(.*)$", 1)
    return F.nullif(strip(F.regexp_replace(found, rf"(?s)(?:{stop_numeral}、)?{_any(stop)}.*$", "")), F.lit(""))


def card_summary(profile: Profile = SHANGHAI_PM) -> Column:
    """Of a contract record: responsibilities and requirements as short lists, or a fallback line where there are none.

    Where a section is noise it is cut from the whole text; where requirements are unknown they are cut from the duties.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = blank("job_description_raw")
    duties = F.when(is_noise(blank("responsibilities"), profile), F.coalesce(_last(raw, "一", profile.duty_sections, "二", profile.requirement_sections), blank("responsibilities"))).otherwise(blank("responsibilities"))
    needs = F.when(is_noise(blank("requirements"), profile), F.coalesce(_last(raw, "二", profile.requirement_sections, "三", profile.closing_sections), blank("requirements"))).otherwise(blank("requirements"))
    said = [F.when(~is_unknown(c), F.concat(F.lit(label), F.col(c))) for label, c in (("薪资：", "salary"), ("经验：", "workExperience"), ("学历：", "education"))]
    ways = F.when(F.size("directions") > 0, F.concat(F.lit("方向："), F.array_join("directions", "、")))
    line = F.concat_ws(" · ", *said, ways, F.lit(NO_TEXT))

    def split(both: Column) -> Column:
        cut = _place(both["duties"], "(?:工作要求|能力要求|任职要求|职位要求)[：:]?")
        here = (both["needs"] == "unknown") & (cut > 1)
        first = display_items(F.when(here, F.left(both["duties"], cut - 1)).otherwise(both["duties"]), profile)
        second = display_items(F.when(here, _from(both["duties"], cut)).otherwise(both["needs"]), profile)
        return F.struct(first.alias("responsibilities"), second.alias("requirements"))

    lists = let(F.struct(duties.alias("duties"), needs.alias("needs")), split)
    return let(lists, lambda x: F.struct(x["responsibilities"].alias("responsibilities"), x["requirements"].alias("requirements"), F.when((F.size(x["responsibilities"]) == 0) & (F.size(x["requirements"]) == 0), line).alias("fallback")))


def risk_texts(flags: Column) -> Column:
    """A line for each risk flag: reason and evidence, or the flag as JSON where it has neither."""
    line = lambda x: F.concat_ws("：", F.nullif(x["reason"], F.lit("")), F.nullif(x["evidence"], F.lit("")))
    return F.transform(flags, lambda x: F.coalesce(F.nullif(line(x), F.lit("")), F.to_json(x)))


def display_value(value: Column) -> Column:
    return F.coalesce(known(value), F.lit(NOT_KNOWN))


def verification_label(status: Column) -> Column:
    """The label of a known status, any other as it is."""
    pairs = [F.lit(x) for pair in VERIFICATION_LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), status)

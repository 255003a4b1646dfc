"""Natural-language questions to filters, a cleaned query and an intent. The wording is Korean and English."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# ---- fixed values: wording that is recognised ----
SOURCE_WORDS = {
    "email": r"이메일|메일|mail|email|eml",
    "teams_chat": r"팀즈|teams|채팅|chat|대화",
    "document": r"문서|보고서|리포트|document|report|pdf|docx|pptx|xlsx",
    "attachment": r"첨부\s*파일|attachment",
}
SOURCE_PHRASE = r"(이메일|메일|팀즈|teams|채팅|문서|보고서|첨부\s*파일)\s*(에서|중에서?|내에서?|으로|만|에서만|중에|속에서?)\s*"
DATE_PHRASE = (
    r"\d{4}\s*년\s*\d{1,2}\s*월\s*(?:부터|에서)?\s*(?:\d{1,2}\s*월\s*(?:까지|사이))?\s*"
    r"|(?:최근|지난)\s*\d+\s*(?:개월|달|주|일)\s*(?:간|동안|내)?\s*|\d{4}\s*년\s*|\d{1,2}\s*월\s*(?:에|의|부터|까지)?\s*"
)
ISO_DATE, YEAR, YEAR_MONTH = r"\d{4}-\d{2}-\d{2}", r"(\d{4})\s*년", r"(\d{4})\s*년\s*(\d{1,2})\s*월"
MONTH_RANGE = r"(\d{1,2})\s*월\s*(?:부터|에서)\s*(\d{1,2})\s*월\s*(?:까지|사이)"
PARTICIPANT = r"([가-힣]{2,4})(?:이|가|에게|한테|께서|으?로부터)\s*(?:보낸|받은|작성|참여|관련|온|쓴|메일|이메일)"
NAME = r"(?:[가-힣]{2,4}|[A-Za-z][A-Za-z0-9._\-]*(?:@[A-Za-z0-9._\-]+)?)"
AUTHOR = [
    rf"({NAME})\s*(?:이|가|이가)?\s*(?:만들었던|만들고|만든|작성했던|작성하고|작성한|생성하고|생성한|쓰고|쓴|기안하고|기안한)(?![가-힣])",
    rf"\b(?:created|written|authored|made|drafted)\s+by\s+({NAME})\b",
    rf"(?:\bauthor\b|작성자)\s*(?:은|는|이|가|:|=)?\s+({NAME})",
]
MODIFIER = [
    rf"({NAME})\s*(?:이|가|이가)?\s*(?:마지막으?로\s*)?(?:수정하고|수정한|편집하고|편집한|업데이트하고|업데이트한)(?![가-힣])",
    rf"\b(?:last\s+)?(?:modified|edited|revised|updated)\s+by\s+({NAME})\b",
    rf"(?:마지막\s*)?(?:\blast\s+modifier\b|수정자|편집자)\s*(?:은|는|이|가|:|=)?\s+({NAME})",
]
INTENTS = {"timeline": r"시간\s*순|타임라인|timeline|연대기|경과", "compare": r"비교|차이|compare|diff", "summarize": r"요약|정리|summarize|summary"}
# ---- end of fixed values ----


@dataclass
class ParsedQuery:
    original: str
    cleaned: str
    filters: dict = field(default_factory=dict)
    intent: str = "search"


def _one_or_all(found: list[str]):
    return found[0] if len(found) == 1 else found


def _whole_month(year: int, first: int, last: int) -> dict[str, str]:
    """From the first of a month to the first of the month after `last`, inclusive; to the 31st for December."""
    end = f"{year}-12-31" if last == 12 else f"{year}-{last + 1:02d}-01"
    return {"_date_gte": f"{year}-{first:02d}-01", "_date_lte": end}


def date_filters(text: str, year_hint: int) -> dict[str, str]:
    days = re.findall(ISO_DATE, text)
    if days:
        return {"_date_gte": days[0], "_date_lte": days[1]} if len(days) > 1 else {"_date_eq": days[0]}
    month = re.search(YEAR_MONTH, text)
    if span := re.search(MONTH_RANGE, text):
        return _whole_month(int(month[1]) if month else year_hint, int(span[1]), int(span[2]))
    if month:
        return _whole_month(int(month[1]), int(month[2]), int(month[2]))
    if year := re.search(YEAR, text):
        return _whole_month(int(year[1]), 1, 12)
    return {}


def _without_particle(name: str) -> str:
    if not re.search("[가-힣]", name):
        return name
    if name.endswith("이가"):
        return name[:-2]
    return name[:-1] if len(name) >= 3 and name[-1] in "이가" else name


def _names(patterns: list[str], text: str) -> list[str]:
    found: dict[str, str] = {}
    for n, pattern in enumerate(patterns):
        for name in re.findall(pattern, text, re.I if n else 0):
            name = _without_particle(name).strip()
            if name:
                found.setdefault(name.lower(), name)
    return list(found.values())


def parse_query(query: str, year_hint: int = 2025) -> ParsedQuery:
    """Filters and intent of a question; the cleaned query is without the phrases that became filters."""
    if not (query or "").strip():
        return ParsedQuery(query, query)
    text = cleaned = query.strip()
    filters: dict = {}
    if sources := [kind for kind, words in SOURCE_WORDS.items() if re.search(words, text, re.I)]:
        filters["source_type"] = _one_or_all(sources)
        cleaned = re.sub(SOURCE_PHRASE, " ", cleaned, flags=re.I)
    if dates := date_filters(text, year_hint):
        filters |= dates
        cleaned = re.sub(DATE_PHRASE, " ", cleaned)
    if people := list(dict.fromkeys(re.findall(PARTICIPANT, text))):
        filters["participants"] = people
    for key, patterns in (("author", AUTHOR), ("last_modified_by", MODIFIER)):
        if names := _names(patterns, text):
            filters[key] = _one_or_all(names)
    intent = next((name for name, words in INTENTS.items() if re.search(words, text, re.I)), "search")
    return ParsedQuery(text, " ".join(cleaned.split()) or text, filters, intent)


def merge_filters(parsed: dict, explicit: dict | None) -> dict:
    """Key by key, the explicit one wins."""
    return {**parsed, **{k: v for k, v in (explicit or {}).items() if v is not None}}

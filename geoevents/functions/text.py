"""Text expressions: street and agency normal forms, tags, ids, JSON and HTML helpers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoevents.functions import fixed_values as V


def _fold_table() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one ASCII character plus marks."""
    src, dst = [], []
    blocks = [(0xA0, 0x24F), (0x1E00, 0x1EFF), (0xFF01, 0xFF5E)]
    for lo, hi in blocks:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            base = [c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)]
            if len(base) == 1 and base[0] != ch and ord(base[0]) < 128:
                src.append(ch)
                dst.append(base[0])
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = _fold_table()


def fold_accents(c: Column) -> Column:
    """Accent-free text: precomposed letters are mapped, remaining combining marks removed."""
    return F.regexp_replace(F.translate(c, _FOLD_FROM, _FOLD_TO), r"\p{M}", "")


# All white space, not spaces alone: controls, no-break and typographic spaces.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def norm_street(c: Column) -> Column:
    """Accent-free, lower-case, trimmed; NULL gives the empty string."""
    return strip(F.lower(fold_accents(F.coalesce(c, F.lit("")))))


def norm_street_abbrev(c: Column) -> Column:
    """Upper-case, accent-free, abbreviations written out, single spaces."""
    out = strip(F.upper(fold_accents(F.coalesce(c, F.lit("")))))
    for pattern, word in V.STREET_ABBREVIATIONS:
        out = F.regexp_replace(out, pattern, word)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def dedupe_prefix(c: Column) -> Column:
    """'avenida avenida x' -> 'avenida x' on the lower-case trimmed name; NULL gives ''."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(low, V.REPEATED_PREFIX, "$1"))


def dedupe_leading_prefix(c: Column) -> Column:
    """Fallback street key: a repeated first word 'praia'/'praca' is kept once."""
    return F.regexp_replace(c, V.REPEATED_LEADING_PREFIX, "$1 ")


def contains_ci(c: Column, text: str) -> Column:
    """Trimmed case-insensitive contains; NULL is the empty text."""
    return F.lower(strip(F.coalesce(c, F.lit("")))).contains(text.strip().lower())


def match_kind(c: Column, kind: str) -> Column:
    """True when the description holds one of the words of ``kind``."""
    low = F.lower(c)
    hit = F.lit(False)
    for word in V.KIND_WORDS[kind]:
        hit = hit | low.contains(word)
    return F.coalesce(hit, F.lit(False))


def type_regex(c: Column, pattern: str) -> Column:
    """Case-insensitive search; NULL counts as no match."""
    return F.coalesce(c.rlike("(?i)" + pattern), F.lit(False))


def keyword_prefilter(c: Column) -> Column:
    """Posts that mention robbery, theft or a related street condition."""
    return F.coalesce(c.rlike("(?iU)" + V.POST_KEYWORDS), F.lit(False))


def _stem(pattern: str) -> str:
    """Longest literal text every match of a tag pattern holds."""
    return max(re.split(r"\\b|\[[^\]]*\]|.\?", pattern), key=len)


def extract_modus(c: Column) -> Column:
    """Tags whose first matching pattern occurs, in the fixed tag order; NULL gives [].

    A plain text search for the patterns' stems comes first: most texts hold none of them and
    never reach the regular expression."""
    low = F.lower(F.coalesce(c, F.lit("")))
    tags = [
        F.when(_any(low, [_stem(p) for p in patterns]) & low.rlike("(?U)(" + "|".join(patterns) + ")"), F.lit(tag))
        for tag, patterns in V.MODUS_PATTERNS.items()
    ]
    return F.array_compact(F.array(*tags))


def lookup(c: Column, mapping: dict, default: Column | None = None) -> Column:
    """Dictionary mapping of a column (fixed small dictionaries only)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), c)
    return hit if default is None else F.coalesce(hit, default)


def offence_to_type(c: Column) -> Column:
    key = F.trim(F.lower(c))
    known = lookup(key, V.OFFENCE_TYPES, F.lit("outro"))
    return F.when(c.isNull() | (c == ""), F.lit("desconhecido")).otherwise(known)


def tip_to_type(classe: Column, tipo: Column) -> Column:
    """Offence type of a tip from its class and type texts."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    blob = F.concat_ws(" ", F.lower(empty(classe)), F.lower(empty(tipo)))
    has = lambda *words: F.lit(False) if not words else _any(blob, words)
    property_type = (
        F.when(has("transeunte"), "roubo_transeunte")
        .when(has("motoris", "veicul"), "roubo_veiculo")
        .when(has("coletiv", "transp"), "roubo_transporte_coletivo")
        .otherwise("outro")
    )
    return (
        F.when((empty(classe) == "") & (empty(tipo) == ""), "desconhecido")
        .when(has("patrim", "roubo", "furto"), property_type)
        .when(has("entorpec", "drog"), "outro")
        .otherwise("desconhecido")
    )


def _any(c: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def norm_agency(c: Column) -> Column:
    """Exact dictionary first, then the word cascade, else the name itself."""
    up = F.upper(c)
    cascade = None
    for agency, words in V.AGENCY_WORDS:
        cond = _any(up, words)
        if agency == V.AGENCY_PREFIX[0]:
            cond = cond | up.startswith(V.AGENCY_PREFIX[1])
        cascade = F.when(cond, agency) if cascade is None else cascade.when(cond, agency)
    return lookup(c, V.AGENCY_NAMES, cascade.otherwise(c))


def age_bracket(c: Column) -> Column:
    """Closed age category from text or number (carried only, never scored)."""
    s = F.trim(F.lower(c))
    n = F.floor(s.try_cast("double"))
    return (
        F.when(c.isNull() | (s == ""), "desconhecido")
        .when(_any(s, ["crianc", "menor"]), "crianca")
        .when(s.contains("adolesc"), "adolescente")
        .when(s.contains("jovem"), "jovem")
        .when(s.contains("idos"), "idoso")
        .when(n.isNull() | F.isnan(s.try_cast("double")), "desconhecido")
        .when(n < 12, "crianca")
        .when(n < 18, "adolescente")
        .when(n < 30, "jovem")
        .when(n < 60, "adulto")
        .otherwise("idoso")
    )


def _category(c: Column, rules: list[tuple[list[str], str]], unknown: str) -> Column:
    low = F.lower(c)
    out = F.when(c.isNull(), unknown)
    for words, label in rules:
        out = out.when(_any(low, words), label)
    return out.otherwise(unknown)


def height_bracket(c: Column) -> Column:
    rules = [(["baix"], "baixa"), (["alt"], "alta"), (["med", "média"], "media")]
    return _category(c, rules, "desconhecida")


def build_bracket(c: Column) -> Column:
    rules = [
        (["magr"], "magro"), (["fort", "atlet"], "forte"),
        (["obes", "gord"], "obeso"), (["medi", "média"], "medio"),
    ]
    return _category(c, rules, "desconhecido")


def skin_category(c: Column) -> Column:
    """Source text to its closed category; an opaque descriptor no score may read."""
    rules = [
        (["branc"], "branca"), (["pard", "morena"], "parda"), (["pret", "negr"], "preta"),
        (["amarel"], "amarela"), (["indig"], "indigena"),
    ]
    return _category(c, rules, "desconhecida")


def parse_json_array(c: Column) -> Column:
    """JSON list text -> trimmed non-empty strings; a scalar or unparsable text -> one element."""
    s = strip(F.coalesce(c, F.lit("")))
    as_list = F.from_json(s, "array<string>")
    cleaned = F.filter(F.transform(as_list, strip), lambda x: x != "")
    scalar = strip(F.regexp_replace(s, r'^"(.*)"$', "$1"))
    empty = F.array().cast("array<string>")
    return (
        F.when(s.isin("", "nan", "[]"), empty)
        .when(s.startswith("[") & as_list.isNotNull(), cleaned)
        .when(scalar == "", empty)
        .otherwise(F.array(scalar))
    )


def profile_text(sex: Column, age: Column, skin: Column) -> Column:
    """Short reported-profile text from the first element of each JSON list."""
    first = lambda c: F.try_element_at(parse_json_array(c), F.lit(1))
    sex1 = first(sex)
    sex_txt = F.when(sex1 == "M", "Homem").when(sex1 == "F", "Mulher").otherwise(sex1)
    years = first(age).try_cast("double").try_cast("int")
    age_txt = F.when(years.isNotNull(), F.concat(years.cast("string"), F.lit(" anos")))
    skin1 = first(skin)
    skin_txt = F.when(skin1.isNotNull(), F.concat(F.lit("pele "), F.lower(skin1)))
    return F.concat_ws(", ", sex_txt, age_txt, skin_txt)


def event_id(kind: Column, source_id: Column) -> Column:
    """First 16 hex digits of the SHA-1 of 'kind:source id'."""
    return F.substring(F.sha1(F.concat_ws(":", kind, source_id).cast("binary")), 1, 16)


def row_hash(columns: list[str]) -> Column:
    """Fallback id: SHA-1 over 'name=value' of the sorted columns, joined by '|'."""
    parts = [
        F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("None")))
        for n in sorted(columns)
    ]
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 16)


def canonical_url(c: Column) -> Column:
    """Scheme, host and path; query string and fragment dropped."""
    return F.regexp_replace(c, r"[?#].*$", "")


def article_id(url: Column) -> Column:
    return F.substring(F.sha1(url.cast("binary")), 1, 16)


def parse_count_suffix(c: Column) -> Column:
    """'4.2K' -> 4200, '1,234' -> 1234, 'M' = million; bad or empty -> 0."""
    s = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), ",", "")))
    mult = F.when(s.endswith("k"), 1_000.0).when(s.endswith("m"), 1_000_000.0).otherwise(1.0)
    value = F.regexp_replace(s, "[km]$", "").try_cast("double") * mult
    return F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint"))


def strip_tags(c: Column) -> Column:
    """Markup removed, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))


def loose_json(c: Column) -> Column:
    """Model answer text -> the JSON object in it: code fences cut, outer braces kept."""
    bare = F.trim(F.regexp_replace(c, r"(?im)^```(?:json)?\s*|\s*```$", ""))
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def short_name(c: Column) -> Column:
    head = F.split_part(c, F.lit(" - "), F.lit(1))
    head = F.regexp_replace(head, r"^Estações? ", "")
    head = F.regexp_replace(head, r"^Metrô ", "")
    return F.trim(F.regexp_replace(head, r"^Av ", "Av. "))


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def base_label(area: Column) -> Column:
    label, words = V.COAST_BASE
    return F.when(_any(area, words), label).otherwise(V.CENTRAL_BASE)


def article_author(c: Column) -> Column:
    found = F.regexp_extract(c, V.ARTICLE_AUTHOR, 1)
    return F.nullif(F.trim(F.regexp_replace(found, r"^[\s—]+|[\s—]+$", "")), F.lit(""))


def article_published(c: Column) -> Column:
    """Timestamp from 'dd/mm/yyyy HHhMM' in the publication line; NULL when absent."""
    part = lambda i: F.regexp_extract(c, V.ARTICLE_DATE, i)
    iso = F.concat(
        part(3), F.lit("-"), part(2), F.lit("-"), part(1), F.lit(" "), part(4), F.lit(":"), part(5)
    )
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd HH:mm"))

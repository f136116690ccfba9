"""Review text cleaning as built-in Spark expressions (P2, P3a-P3i, P4, F1, F2).

No Python worker is involved: each step is a JVM regexp or a higher-order
array function, so cleaning stays inside whole-stage code generation and
runs on whole texts of any length.

Regex dialect (T19): the reference cleans with Python ``re``, whose ``.``
stops only at ``\\n`` and whose ``\\s`` is Unicode whitespace. Java differs
on both, so the patterns spell out the whitespace class and use ``[^\\n]``
instead of ``.``; the same pattern text then behaves alike in Java, Python
and RE2.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python str.isspace() characters, as a regex class body.
WS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")

TAG_RE = r"<[^\n]*?>"
URL_RE = rf"http[^{WS}]+|www\.[^{WS}]+"
# Replacing each non-letter by a space and then squeezing whitespace runs is the
# same as replacing every run of non-letters (whitespace included) by one space.
NON_LETTERS_RE = r"[^a-z]+"

# English stopword list used by the cleaning step (the common
# 179-word NLTK English list).
ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't",
    "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn",
    "wouldn't",
]
# Negations kept by the cleaning step.
NEGATIONS = ["no", "not", "nor", "never", "neither", "none",
             "don't", "doesn't", "didn't", "won't", "wouldn't", "can't", "cannot",
             "isn't", "aren't", "wasn't", "weren't"]

CLEAN_STOPWORDS = [w for w in ENGLISH_STOPWORDS if w not in set(NEGATIONS)]
# Only tokens of 3+ letters reach the stopword test, so only those entries matter.
_STOP_TESTED = [w for w in CLEAN_STOPWORDS if len(w) > 2 and w.isalpha()]

# Irregular noun plurals for the lemma step (T16: no WordNet offline; a
# user dictionary table can extend this, see operators.lemmas).
IRREGULAR_LEMMAS = {
    "movies": "movie", "calories": "calorie", "brownies": "brownie", "cookies": "cookie", "pies": "pie",
    "ties": "tie", "lies": "lie", "smoothies": "smoothie", "veggies": "veggie", "foodies": "foodie",
    "lenses": "lens", "buses": "bus", "gases": "gas", "viruses": "virus", "bonuses": "bonus",
    "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth",
    "mice": "mouse", "geese": "goose", "leaves": "leaf", "knives": "knife", "wives": "wife",
    "lives": "life", "halves": "half", "shelves": "shelf", "loaves": "loaf", "wolves": "wolf",
    "potatoes": "potato", "tomatoes": "tomato", "heroes": "hero", "echoes": "echo",
    "cacti": "cactus", "fungi": "fungus", "analyses": "analysis", "crises": "crisis",
    "theses": "thesis", "phenomena": "phenomenon", "criteria": "criterion",
}
# Words ending in "s" that are already singular.
SINGULAR_S = ["gas", "yes", "always", "perhaps", "news", "series", "species", "means",
              "lens", "thanks", "whereas", "towards", "afterwards"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full_text(summary="Summary", text="Text") -> Column:
    """Summary + '. ' + Text with missing parts as ''."""
    return F.concat(F.coalesce(_c(summary), F.lit("")), F.lit(". "), F.coalesce(_c(text), F.lit("")))


def _replaced(s: Column, pattern: str, *marks: str) -> Column:
    """Every match of ``pattern`` by a space; a text without its marks has none and is not searched.

    The text is an array of one, so that it is made once and not at every place that names it.
    """
    has = lambda x: functools.reduce(lambda a, b: a | b, [x.contains(m) for m in marks])
    return F.element_at(F.transform(F.array(s), lambda x: F.when(has(x), F.regexp_replace(x, pattern, " ")).otherwise(x)), 1)


def _without_markup(col) -> Column:
    """P3a-P3d: '' for null, lower, drop tags and URLs."""
    s = F.lower(F.coalesce(_c(col), F.lit("")))
    return _replaced(_replaced(s, TAG_RE, "<"), URL_RE, "http", "www.")


def normalise(col) -> Column:
    """P3a-P3f: '' for null, lower, drop tags / URLs / non-letters, squeeze spaces."""
    return F.trim(F.regexp_replace(_without_markup(col), NON_LETTERS_RE, " "))


def _ends(x: Column, *suffixes: str) -> Column:
    cond = x.endswith(suffixes[0])
    for suf in suffixes[1:]:
        cond = cond | x.endswith(suf)
    return cond


def _drop(x: Column, n: int) -> Column:
    return x.substr(F.lit(1), F.length(x) - n)


def lemma_rule(x: Column) -> Column:
    """P3i fallback: plural suffix rules for words missing from the dictionary."""
    return (F.when(F.length(x) <= 3, x)
            .when(x.isin(*SINGULAR_S), x)
            .when(x.endswith("sses"), _drop(x, 2))
            .when(x.endswith("ies") & (F.length(x) > 4), F.concat(_drop(x, 3), F.lit("y")))
            .when(x.endswith("aches") & ~_ends(x, "eaches", "oaches"), _drop(x, 1))
            .when(_ends(x, "xes", "zzes", "ches", "shes"), _drop(x, 2))
            .when(_ends(x, "ss", "us", "is"), x)
            .when(x.endswith("s"), _drop(x, 1))
            .otherwise(x))


# The rules touch no word without a final s, and a map is searched entry by entry: most words need neither.
_OTHER_PLURALS = [w for w in IRREGULAR_LEMMAS if not w.endswith("s")]


def lemma(x: Column) -> Column:
    irregular = F.create_map(*[F.lit(v) for kv in IRREGULAR_LEMMAS.items() for v in kv])
    return (F.when(x.endswith("s") | x.isin(*_OTHER_PLURALS), F.coalesce(F.try_element_at(irregular, x), lemma_rule(x)))
            .otherwise(x))


def clean_tokens(col, lemmatise: bool = True) -> Column:
    """P3g-P3i: split, drop stopwords (negations kept) and short tokens, lemmatise.

    Without ``lemmatise`` the tokens stay inflected, as a dictionary table
    (``operators.lemmas``) must see them.
    """
    toks = F.split(_without_markup(col), NON_LETTERS_RE)  # the words of ``normalise``; an empty one at the ends goes as too short
    kept = F.filter(toks, lambda t: (F.length(t) > 2) & ~t.isin(*_STOP_TESTED))
    return F.transform(kept, lemma) if lemmatise else kept


def clean_text(col, lemmatise: bool = True) -> Column:
    """The full cleaning chain, tokens joined by single spaces."""
    return F.array_join(clean_tokens(col, lemmatise), " ")


def fill_cleaned(cleaned="cleaned", summary="Summary", text="Text") -> Column:
    """Keep a provided cleaned text, clean only when it is NULL or ''; never NULL."""
    c = _c(cleaned)
    redo = clean_text(F.concat_ws(". ", _c(summary), _c(text)))
    return F.coalesce(F.when(c.isNull() | (c == ""), redo).otherwise(c), F.lit(""))


def text_length(col) -> Column:
    """code-point length, NULL as ''."""
    return F.length(F.coalesce(_c(col), F.lit("")))


# ----------------------------------------------------------------- oracle SQL
def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def clean_text_sql(col: str, dictionary: str = "null") -> str:
    """``clean_text`` as DuckDB SQL (RE2), for the oracle queries; ``dictionary`` is looked up before the rules."""
    s = f"lower(coalesce({col}, ''))"
    s = f"regexp_replace({s}, '{TAG_RE}', ' ', 'g')"
    s = f"regexp_replace({s}, '{URL_RE}', ' ', 'g')"
    s = f"trim(regexp_replace({s}, '{NON_LETTERS_RE}', ' ', 'g'), ' ')"
    irregular = " ".join(f"when '{k}' then '{v}'" for k, v in IRREGULAR_LEMMAS.items())
    rule = (f"case when length(x) <= 3 then x when list_contains({_sql_list(SINGULAR_S)}, x) then x "
            "when suffix(x, 'sses') then regexp_replace(x, 'es$', '') "
            "when suffix(x, 'ies') and length(x) > 4 then regexp_replace(x, 'ies$', 'y') "
            "when suffix(x, 'aches') and not regexp_matches(x, '(eaches|oaches)$') then regexp_replace(x, 's$', '') "
            "when regexp_matches(x, '(xes|zzes|ches|shes)$') then regexp_replace(x, 'es$', '') "
            "when regexp_matches(x, '(ss|us|is)$') then x "
            "when suffix(x, 's') then regexp_replace(x, 's$', '') else x end")
    lem = f"coalesce({dictionary}, case x {irregular} end, {rule})"
    kept = (f"list_filter(string_split({s}, ' '), "
            f"lambda x: length(x) > 2 and not list_contains({_sql_list(_STOP_TESTED)}, x))")
    return f"array_to_string(list_transform({kept}, lambda x: {lem}), ' ')"

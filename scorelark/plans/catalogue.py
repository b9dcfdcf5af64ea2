"""All queries of the engine by name, with the SQL that gives the same rows.

Texts of the test tables hold next to none of the listed words, so line queries
run over their lines and a fixture's lines together. Where a list is a
parameter, a stand-in is bound here by a stated rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelark.functions import lexicons as lx
from scorelark.functions import text as tx
from scorelark.operators import competencies, facts, impact, layout, scoring, spelling, structure
from scorelark.rules import Rules
from scorelark.sources.tables import FIXTURE, LINES_SQL, spread, table, with_fixture

#: Everyday verbs, a parameter of the operators; these few stand in for it here.
STANDARD = ["analyze", "author", "build", "lead", "manage", "plan", "study", "teach", "test", "write"]
#: Terms of the competencies, a parameter as well: words that the test tables have, and some of every kind that a term can be.
TERMS = {
    "analytical": list(lx.TOOLS), "communication": ["presented", "of", "that", "support", "wrote to"], "leadership": ["led", "for", "raised", "and the"],
    "teamwork": ["team", "teams", "with", "us"], "initiative": ["launched", "built", "in", "a/b test", "co-authored"],
}
RULES = Rules()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_fixture(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return put


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {_q(pattern)})"


def _lost(text: str, phrases) -> str:
    """How often phrases stand between blanks."""
    low = f"(' ' || lower({text}) || ' ')"
    return "(" + " + ".join(f"CAST((length({low}) - length(replace({low}, {_q(f' {p} ')}, ''))) / {len(p) + 2} AS INTEGER)" for p in phrases) + ")"


BODY = r"regexp_replace(text, '^[•●▪◦‣⁃·■○∙\-–—*o>\s]+|\s+$', '', 'g')"
KEPT = f"kept AS (SELECT *, {BODY} AS body FROM lines WHERE length(regexp_replace({BODY}, '[^A-Za-z0-9]', '', 'g')) >= 2)"

def _numbers(text: str) -> str:
    # RE2 knows ASCII word boundaries only, so letters beyond ASCII are put as ASCII ones
    text = f"regexp_replace({text}, '[À-ɏͰ-῿]', 'a', 'g')"
    masked = f"regexp_replace({text}, {_q(tx.YEAR)}, ' ', 'g')"
    spelled = f"len(list_filter({_all(text, tx.WORD)}, lambda w: lower(w) IN ({lx.quoted(lx.SPELLED_NUMBERS)})))"
    return f"(len({_all(masked, tx.NUMBER)}) + len({_all(masked, tx.RATIO)}) + len({_all(text, tx.ROMAN)}) + {spelled})"


def _tok(source: str, text: str = "text") -> str:
    """A table with the words of a column as they are (toks) and in lower case (low)."""
    return f"(SELECT *, list_transform(toks, lambda w: lower(w)) AS low FROM (SELECT *, {_all(text, tx.WORD)} AS toks FROM {source}))"


def _passive() -> str:
    participle = f"(x IN ({lx.quoted(lx.IRREGULAR_PARTICIPLES)}) OR (ends_with(x, 'ed') AND length(x) > 4 AND x NOT IN ({lx.quoted(lx.WEAK_VERBS)})))"
    return f"(len(list_filter(low, lambda w, i: w IN ({lx.quoted(lx.BE_VERBS)}) AND len(list_filter(list_slice(low, i + 1, i + 2), lambda x: {participle})) > 0)) > 0)"


def _tools(text: str) -> str:
    def hit(t: str) -> str:
        if " " in t:
            return f"contains(lower({text}), {_q(t)})"
        return f"regexp_matches(lower({text}), {_q('(?:^|[^a-z])' + ''.join(chr(92) + c if c in '+.&' else c for c in t) + '(?:$|[^a-z])')})"

    return "list_filter([" + ", ".join(f"CASE WHEN {hit(t)} THEN {_q(t)} END" for t in sorted(lx.TOOLS)) + "], lambda x: x IS NOT NULL)"



def _filler(text: str) -> str:
    return f"(len(list_filter(low, lambda w: w IN ({lx.quoted(tx.FILLERS)}))) + {_lost(text, lx.WEASEL_PHRASES)})"


def _pronouns(text: str) -> str:
    return f"(len(list_filter(toks, lambda w, i: lower(w) IN ({lx.quoted(lx.FIRST_PERSON)}) AND (w <> upper(w) OR regexp_matches(coalesce(toks[i + 1], ''), '^[a-z]')))) + {_lost(text, lx.PRONOUN_PHRASES)})"


def _avoided(text: str) -> str:
    """What a bullet should do without, sorted; ``low`` has the words."""
    listed = (*lx.FILLER_ADVERBS, *lx.PRONOUNS, *(w for w in lx.BUZZWORDS if " " not in w), *lx.ARTICLES)
    padded, bare = f"(' ' || lower({text}) || ' ')", f"regexp_replace(lower({text}), '^\\s+|\\s+$', '', 'g')"
    single, several = [w for w in lx.VAGUE_QUANTIFIERS if " " not in w], [w for w in lx.VAGUE_QUANTIFIERS if " " in w]
    phrases = [f"CASE WHEN contains({padded}, {_q(f' {p} ')}) OR starts_with({bare}, {_q(p)}) THEN {_q(p)} END" for p in lx.WEASEL_PHRASES] + [f"CASE WHEN contains({padded}, {_q(f' {p} ')}) THEN {_q(p)} END" for p in several]
    vague = _all(f"regexp_replace(lower({text}), '[À-ɏͰ-῿]', 'a', 'g')", rf"\b(?:{'|'.join(single)})\b")
    return f"list_sort(list_distinct(list_filter(list_filter(low, lambda w: w IN ({lx.quoted(listed)})) || {vague} || [{', '.join(phrases)}], lambda x: x IS NOT NULL)))"


#: Bullets of lines: lists and credentials are none.
BULLETS = f"bul AS (SELECT * FROM kept WHERE NOT regexp_matches(body, {_q(tx.LIST_LABEL)}) AND NOT regexp_matches(body, {_q(tx.CREDENTIAL)}))"


@query(f"WITH {LINES_SQL}, {KEPT} SELECT doc_id, count(*) AS n_lines, CAST(sum(len({_all('text', tx.COUNTED_WORD)})) AS BIGINT) AS n_words FROM kept GROUP BY doc_id")
def lines_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.word_counts(_lines(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, {KEPT}, n AS (SELECT doc_id, {_numbers('text')} AS n FROM kept)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (n > 0) AS n_quantified, avg(CAST(n > 0 AS DOUBLE)) AS share, CAST(sum(n) AS BIGINT) AS n_numbers FROM n GROUP BY doc_id""")
def number_specifics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.numbers(_lines(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, n AS (SELECT doc_id, len(toks) AS w, {_filler('text')} AS f, {_pronouns('text')} AS p FROM {_tok('lines')}),
s AS (SELECT doc_id, CAST(sum(w) AS BIGINT) AS n_words, CAST(sum(f) AS BIGINT) AS n_filler, CAST(sum(p) AS BIGINT) AS n_pronouns FROM n GROUP BY doc_id)
SELECT *, 8.0::DOUBLE - 8.0::DOUBLE * least(1.0::DOUBLE, 0.6::DOUBLE * least(1.0::DOUBLE, n_filler / 16.0::DOUBLE) + 0.4::DOUBLE * least(1.0::DOUBLE, n_pronouns / 8.0::DOUBLE)) AS points,
  CASE WHEN n_pronouns > 0 THEN 'Needs Work!' WHEN n_filler > 0 THEN 'On Track!' ELSE 'Good Job!' END AS status FROM s""")
def avoided_words_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.avoided(_lines(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, {KEPT} SELECT doc_id, count(*) FILTER (p) AS n_passive, avg(CAST(p AS DOUBLE)) AS share FROM (SELECT doc_id, {_passive()} AS p FROM {_tok('kept')}) GROUP BY doc_id""")
def passive_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.passive(_lines(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, t AS (SELECT doc_id, unnest({_tools('text')}) AS tool FROM lines) SELECT doc_id, tool, count(*) AS n_lines FROM t GROUP BY ALL""")
def tools_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.tools_named(_lines(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, {KEPT}, {BULLETS}, e AS (SELECT doc_id, avg(CAST({_numbers('body')} > 0 AS DOUBLE)) AS quantified, avg(CAST(len({_tools('body')}) > 0 AS DOUBLE)) AS tooled, avg(CAST({_passive()} AS DOUBLE)) AS passive FROM {_tok('bul', 'body')} GROUP BY doc_id)
SELECT *, greatest(0.0::DOUBLE, least(12.0::DOUBLE, 12.0::DOUBLE * (0.5::DOUBLE * least(1.0::DOUBLE, quantified / 0.6::DOUBLE) + 0.5::DOUBLE * least(1.0::DOUBLE, tooled / 0.15::DOUBLE) - least(0.25::DOUBLE, passive * 0.5::DOUBLE)))) AS points FROM e""")
def specifics_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.specifics(_lines(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, {KEPT}, {BULLETS}, n AS (SELECT lang, {_numbers('body')} AS n FROM bul JOIN documents USING (doc_id))
SELECT lang, count(*) AS total, count(*) FILTER (n = 0) AS missing FROM n GROUP BY lang HAVING count(*) FILTER (n > 0) < 0.6::DOUBLE * count(*)""")
def poor_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of bullets that lack quantities; the language of a document stands for its section."""
    langs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return impact.poor_sections(_lines(spark, sf_dir).join(F.broadcast(langs) if langs.count() <= 1_000_000 else langs, "doc_id"), "lang")


def _endings_sql(t: str) -> str:
    n = f"length({t})"
    return f"""[CASE WHEN ends_with({t}, 'ied') OR (ends_with({t}, 'ies') AND {n} > 4) THEN substr({t}, 1, {n} - 3) || 'y' END,
  CASE WHEN ends_with({t}, 'ed') THEN substr({t}, 1, {n} - 2) END, CASE WHEN ends_with({t}, 'ed') THEN substr({t}, 1, {n} - 1) END,
  CASE WHEN ends_with({t}, 'ing') THEN substr({t}, 1, {n} - 3) END, CASE WHEN ends_with({t}, 'ing') THEN substr({t}, 1, {n} - 3) || 'e' END,
  CASE WHEN ends_with({t}, 's') AND NOT ends_with({t}, 'ss') THEN substr({t}, 1, {n} - 1) END]"""


def _lemmas_sql(source: str) -> str:
    """(w, forms) of the distinct words (column w) of a table."""
    past = "CASE t " + " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in lx.IRREGULAR_PAST.items()) + " END"
    step = f"""SELECT w, t, list_concat([t, {past}], {_endings_sql('t')}, [CASE WHEN length(t) > 4 AND (ends_with(t, 'ed') OR ends_with(t, 'ing')) AND substr(t, length(t) - 2, 1) = substr(t, length(t) - 3, 1) THEN substr(t, 1, length(t) - 3) END]) AS o
  FROM (SELECT DISTINCT w, regexp_replace(lower(w), '^[.,;:()\\[\\]]+|[.,;:()\\[\\]]+$', '', 'g') AS t FROM {source})"""
    for p in tx.PREFIXES:
        k = len(p)
        step = f"""SELECT w, t, CASE WHEN starts_with(t, '{p}') AND length(t) > {k + 2} THEN list_concat(o, list_filter(list_transform(o, lambda x: substr(x, {k + 1})), lambda x: length(x) > 2), [substr(t, {k + 1})], {_endings_sql(f"substr(t, {k + 1})")}) ELSE o END AS o FROM ({step})"""
    return f"SELECT w, list_distinct(list_filter(o, lambda x: x IS NOT NULL AND x <> '')) AS forms FROM ({step})"


def _verbs(words) -> str:
    return f"[{lx.quoted(words)}]"


TIER_SQL = f"""tok AS (SELECT doc_id, line_no, body, {_all('body', tx.WORD)} AS w, regexp_extract(substr(body, 1, 90), '(\\s[—–|]\\s|:\\s)', 1) AS mark, regexp_matches(body, {_q(tx.DETAIL_LABEL)}) AS detail,
  regexp_extract(lower(body), {_q(f"^ *({tx.any_of((*lx.NON_VERB_OPENERS, *lx.NOUN_PHRASE_OPENERS))})".replace("^ *", chr(94) + chr(92) + "s*"))}, 1) AS opener FROM bul),
cand AS (SELECT *, w[1] AS a, w[2] AS b, CASE WHEN mark <> '' THEN {_all("substr(body, instr(body, mark) + length(mark))", tx.WORD)}[1] END AS c FROM tok),
every AS (SELECT a AS w FROM cand UNION SELECT b FROM cand UNION SELECT c FROM cand),
lem AS ({_lemmas_sql('(SELECT w FROM every WHERE w IS NOT NULL)')}),
cls AS (SELECT w, CASE WHEN list_has_any(forms, {_verbs(lx.STRONG_VERBS)}) THEN 'strong' WHEN list_has_any(forms, {_verbs(STANDARD)}) THEN 'standard' WHEN list_has_any(forms, {_verbs(lx.WEAK_VERBS)}) THEN 'weak' ELSE 'none' END AS tier FROM lem),
t3 AS (SELECT cand.*, coalesce(x.tier, 'none') AS ta, coalesce(y.tier, 'none') AS tb, coalesce(z.tier, 'none') AS tc FROM cand LEFT JOIN cls x ON x.w = a LEFT JOIN cls y ON y.w = b LEFT JOIN cls z ON z.w = c),
pick AS (SELECT *, regexp_matches(body, '^\\s*[A-Za-z]+ly\\b') AND tb <> 'none' AS steps FROM t3),
tiers AS (SELECT doc_id, line_no, detail, CASE WHEN opener <> '' OR a IS NULL THEN 'none'
  WHEN steps THEN tb WHEN ta <> 'none' THEN ta WHEN tc <> 'none' THEN tc WHEN ends_with(lower(a), 'ing') THEN 'weak' ELSE 'none' END AS tier,
  CASE WHEN opener <> '' THEN opener WHEN a IS NULL THEN '' WHEN steps THEN b WHEN ta <> 'none' THEN a WHEN tc <> 'none' THEN c ELSE a END AS token FROM pick)"""


@query(f"WITH {LINES_SQL}, {KEPT}, {BULLETS}, {TIER_SQL} SELECT doc_id, line_no, tier, token, detail FROM tiers")
def verb_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.tiers(_lines(spark, sf_dir), STANDARD)


@query(f"""WITH {LINES_SQL}, {KEPT}, {BULLETS}, {TIER_SQL}, w AS (SELECT *, CASE tier WHEN 'strong' THEN 1.0::DOUBLE WHEN 'standard' THEN 0.92::DOUBLE WHEN 'weak' THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM tiers),
g AS (SELECT doc_id, count(*) FILTER (tier = 'strong') AS n_strong, count(*) FILTER (tier = 'standard') AS n_standard, count(*) FILTER (tier = 'weak') AS n_weak, count(*) FILTER (tier = 'none') AS n_none, coalesce(avg(weight) FILTER (NOT detail), avg(weight)) AS mean_weight FROM w GROUP BY doc_id)
SELECT *, 12.0::DOUBLE * mean_weight AS points FROM g""")
def action_oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.action(_lines(spark, sf_dir), STANDARD)


def _over(source: str, text: str) -> str:
    """(doc_id, label, total) of the words that count as overused, in the tables ``c`` to ``flagged``."""
    return f"""c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, lower(unnest({_all(text, tx.WORD)})) AS w FROM {source}) WHERE length(w) >= 4 AND w NOT IN ({lx.quoted((*lx.STOPWORDS, *lx.PRONOUNS, *lx.ARTICLES))}) GROUP BY ALL),
olem AS ({_lemmas_sql('c')}), of AS (SELECT c.*, forms FROM c JOIN olem USING (w) WHERE list_has_any(forms, {_verbs(lx.COMMON_VERBS)}) AND NOT list_has_any(forms, {_verbs(lx.STRONG_VERBS)})),
ok AS (SELECT *, coalesce(list_sort(list_transform(list_filter(forms, lambda x: length(x) >= 4), lambda x: lpad(CAST(length(x) AS VARCHAR), 5, '0') || x))[1][6:], w) AS base, regexp_matches(w, '(ed|ing)$') OR w IN ({lx.quoted(lx.IRREGULAR_PAST)}) AS inflected FROM of),
og AS (SELECT doc_id, base, CAST(sum(n) AS BIGINT) AS total, sum(CASE WHEN inflected THEN n ELSE 0 END) AS i, string_agg(upper(w[1]) || w[2:], '/' ORDER BY w) AS label FROM ok GROUP BY doc_id, base),
flagged AS (SELECT doc_id, label, total FROM og WHERE total >= 3 AND i * 2 >= total)"""


@query(f"WITH {LINES_SQL}, {_over('lines', 'text')} SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, label) AS INTEGER) AS rank FROM flagged")
def overuse_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.overused(_lines(spark, sf_dir), lx.COMMON_VERBS)


@query(f"""WITH {LINES_SQL}, {KEPT}, {BULLETS}, {TIER_SQL}, n AS (SELECT doc_id, line_no, CAST(len({_all('body', tx.LENGTH_TOKEN)}) AS INTEGER) AS n_tokens, body FROM bul),
f AS (SELECT doc_id, line_no, n_tokens, {_avoided('body')} AS a, {_passive()} AS p, {_numbers('body')} = 0 AS q, len({_tools('body')}) = 0 AS t FROM {_tok('n', 'body')}),
m AS (SELECT doc_id, line_no, n_tokens, list_filter([CASE tier WHEN 'none' THEN 'no action verb' WHEN 'weak' THEN 'weak verb “' || token || '”' END, CASE WHEN p THEN 'passive voice' END, CASE WHEN q THEN 'no quantification' END, CASE WHEN t THEN 'no tool or method named' END,
 CASE WHEN len(a) > 0 THEN 'filler: ' || array_to_string(a[1:4], ', ') END,
 CASE WHEN n_tokens < 8 THEN 'too short (' || n_tokens || ' words)' WHEN n_tokens > 80 THEN 'too long (' || n_tokens || ' words)' WHEN n_tokens < 12 OR n_tokens > 55 THEN 'length ' || n_tokens || ' words (aim 12-55)' END], lambda x: x IS NOT NULL) AS f FROM f JOIN tiers USING (doc_id, line_no))
SELECT doc_id, line_no, n_tokens, array_to_string(f, '; ') AS flags FROM m WHERE len(f) > 0""")
def bullet_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.flags(_lines(spark, sf_dir), STANDARD)


@query(f"""WITH {LINES_SQL}, e AS (SELECT doc_id, CAST(sum(len({_all('text', tx.EMAIL)})) AS BIGINT) AS n_email, CAST(sum(len({_all('text', tx.PHONE)})) AS BIGINT) AS n_phone, CAST(sum(len({_all('text', tx.URL)})) AS BIGINT) AS n_url, bool_or(regexp_matches(text, {_q(tx.REFERENCES)})) AS asks_references FROM lines GROUP BY doc_id)
SELECT * FROM e WHERE n_email + n_phone + n_url > 0 OR asks_references""")
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.contacts(_lines(spark, sf_dir))


@query(f"""WITH {LINES_SQL}, {KEPT}, e AS (SELECT doc_id, regexp_matches(text, '[.!?]\\s*$') AS e FROM kept WHERE len({_all('text', tx.COUNTED_WORD)}) >= 4)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (e) AS n_ended, bool_and(e) OR NOT bool_or(e) AS passed FROM e GROUP BY doc_id""")
def bullet_punctuation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.endings(_lines(spark, sf_dir))


@query(f"""WITH {LINES_SQL} SELECT doc_id, line_no, regexp_matches(ltrim(text), '^[•●▪◦‣⁃·■○∙](?:$|[\\sA-Za-z0-9])') OR (regexp_matches(ltrim(text), '^[-–—*o>]\\s') AND NOT regexp_matches(ltrim(text), '^[-–—]\\s*\\d')) AS bullet,
 regexp_matches({BODY}, {_q(tx.LIST_LABEL)}) AS list, regexp_matches({BODY}, {_q(tx.DETAIL_LABEL)}) AS detail, NOT regexp_matches({BODY}, {_q(tx.LIST_LABEL)}) AND regexp_matches({BODY}, {_q(tx.CREDENTIAL)}) AS credential FROM lines""")
def line_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = tx.body_text(F.col("text"))
    return _lines(spark, sf_dir).select("doc_id", "line_no", tx.is_bullet(F.col("text")).alias("bullet"), tx.is_list(body).alias("list"), tx.is_detail(body).alias("detail"), tx.is_credential(body).alias("credential"))


TEXTS_SQL = f"texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT CAST(d AS BIGINT), string_agg(t, chr(10) ORDER BY n) FROM (VALUES {', '.join(f'({d}, {n}, {_q(t)})' for d, n, t in FIXTURE)}) AS v(d, n, t) GROUP BY d)"
FINE = [*lx.MONTHS, *lx.MONTHS_SHORT, *lx.NEVER_UNKNOWN, *lx.COMMONWEALTH]


def _spell(source: str) -> str:
    """(doc_id, form, n, colour, first) of the unknown words of a table's texts; the vocabulary is what the benchmark's items have."""
    tokens = _all("clean", spelling.TOKEN)
    return f"""known AS (SELECT DISTINCT unnest({_all('lower(text)', spelling.TOKEN)}) AS word FROM benchmark),
st AS (SELECT doc_id, unnest({tokens}) AS w, generate_subscripts({tokens}, 1) - 1 AS pos FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), {_q(spelling.ADDRESS)}, ' ', 'g') AS clean FROM {source})),
sn AS (SELECT *, regexp_replace(lower(w), '^[-'']+|[-'']+$', '', 'g') AS word FROM st),
sf AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first, arg_min(w, pos) AS form FROM sn WHERE length(word) >= 3 AND NOT contains(word, '_') AND (word IN ({lx.quoted(lx.ALWAYS_UNKNOWN)}) OR word NOT IN ({lx.quoted(FINE)}) AND word NOT IN (SELECT word FROM known)) GROUP BY doc_id, word),
sc AS (SELECT DISTINCT word, list_filter(regexp_split_to_array(word, '[-''/]'), lambda p: p <> '') AS ps FROM sf WHERE regexp_matches(word, '[-''/]') AND word NOT IN ({lx.quoted(lx.ALWAYS_UNKNOWN)})),
sp AS (SELECT word, unnest(ps) AS p, len(ps) AS k FROM sc), sx AS (SELECT word FROM sp LEFT JOIN known ON p = known.word GROUP BY sp.word HAVING bool_and(k > 1 AND (known.word IS NOT NULL OR length(p) < 3 OR p IN ({lx.quoted((*lx.BEGINNINGS, *lx.SUFFIXES))})))),
su AS (SELECT * FROM sf WHERE word NOT IN (SELECT word FROM sx)),
sm AS (SELECT doc_id, regexp_replace(word, 's+$', '') AS stem, CAST(sum(n) AS BIGINT) AS n, first(form ORDER BY length(form) DESC, first) AS form, CAST(first(first ORDER BY length(form) DESC, first) AS INTEGER) AS first FROM su GROUP BY doc_id, stem),
r AS (SELECT doc_id, form, n, CASE WHEN form <> lower(form) THEN 'yellow' WHEN length(regexp_replace(form, '^[-'']+|[-'']+$', '', 'g')) >= 4 THEN 'red' ELSE 'yellow' END AS colour, first FROM sm)"""


SPELL_SQL = f"{TEXTS_SQL}, {_spell('texts').replace('sx AS (SELECT word FROM', 'sx AS (SELECT sp.word FROM')}"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and the fixture's, as texts."""
    made: dict[int, list[str]] = {}
    for d, _, t in FIXTURE:
        made.setdefault(d, []).append(t)
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).unionByName(spark.createDataFrame([(d, "\n".join(ts)) for d, ts in made.items()], "doc_id long, text string"))


def _unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.unknown(_texts(spark, sf_dir), spelling.vocabulary(table(spark, sf_dir, "benchmark")))


@query(f"WITH {SPELL_SQL} SELECT * FROM r")
def spell_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unknown(spark, sf_dir)


@query(f"WITH {SPELL_SQL} SELECT doc_id, count(*) FILTER (colour = 'red') AS n_red, count(*) FILTER (colour = 'yellow') AS n_yellow, greatest(0.0::DOUBLE, 3.0::DOUBLE - count(*) FILTER (colour = 'red')) AS points FROM r GROUP BY doc_id")
def spell_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.score(_unknown(spark, sf_dir))


def _derived() -> str:
    """(word, ps): the words that a word of ``u`` may be derived from, or be made of."""
    out = []
    for x in lx.SUFFIXES:
        k = len(x)
        stems = [f"substr(word, 1, length(word) - {k})"] + ([f"substr(word, 1, length(word) - {k}) || 'e'", f"substr(word, 1, length(word) - {k}) || 'y'", f"substr(word, 1, length(word) - {k + 1})"] if x[0] in "aeiouy" else [])
        out += [f"SELECT word, [{stem}] AS ps FROM u WHERE ends_with(word, '{x}') AND length(word) - {k} >= 4 AND length({stem}) >= 4" for stem in stems]
    out += [f"SELECT word, [substr(word, {len(x) + 1})] FROM u WHERE starts_with(word, '{x}') AND length(word) - {len(x)} >= 4" for x in lx.BEGINNINGS]
    out.append("SELECT word, [substr(word, 1, i), substr(word, i + 1)] FROM (SELECT word, unnest(range(4, length(word) - 2)) AS i FROM u)")
    return " UNION ALL ".join(out)


@query(f"""WITH {SPELL_SQL}, u AS (SELECT DISTINCT word FROM su WHERE length(word) >= 5), c AS (SELECT word, ps, row_number() OVER () AS i FROM ({_derived()})), p AS (SELECT word, i, unnest(ps) AS p FROM c)
SELECT DISTINCT p.word FROM p LEFT JOIN known ON p = known.word GROUP BY p.word, i HAVING bool_and(known.word IS NOT NULL)""")
def compound_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unknown words that are forms or compounds of known ones, which a lenient check lets pass."""
    known = spelling.vocabulary(table(spark, sf_dir, "benchmark"))
    each = spelling.forms(_texts(spark, sf_dir), known).select("word").distinct()
    return spelling.derivable(each, known)


@query(r"""WITH b AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li)(?:\s[^>]*)?>[^<]*')) AS b, generate_subscripts(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li)(?:\s[^>]*)?>[^<]*'), 1) - 1 AS line_no FROM pages),
l AS (SELECT doc_id, line_no, lower(regexp_extract(b, '^<([A-Za-z0-9]+)', 1)) AS tag, trim(regexp_replace(b, '^<[^>]*>', ''), ' ') AS text FROM b),
s AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS section FROM l)
SELECT doc_id, section, count(*) AS n_lines, count(*) FILTER (tag = 'li') AS n_items, arg_min(text, line_no) AS heading FROM s GROUP BY doc_id, section""")
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.section_sizes(structure.html_lines(table(spark, sf_dir, "pages")))


ROLE = "CASE role WHEN 'user' THEN 'header' WHEN 'assistant' THEN 'bullet' ELSE 'loose' END"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("role") == "user", "header").when(F.col("role") == "assistant", "bullet").otherwise("loose")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), role.alias("role"), "text")


@query(f"""WITH t AS (SELECT DISTINCT conv_id AS doc_id, turn AS seq, {ROLE} AS role FROM conversations),
o AS (SELECT *, role = 'header' AND coalesce(lag(role) OVER (PARTITION BY doc_id ORDER BY seq, role), 'bullet') = 'bullet' AS opens FROM t),
e AS (SELECT *, CAST(sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY seq, role) AS BIGINT) AS entry FROM o)
SELECT doc_id, entry, count(*) FILTER (role = 'header') AS n_headers, count(*) FILTER (role = 'bullet') AS n_bullets, min(seq) AS first_seq FROM e GROUP BY doc_id, entry""")
def entry_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.entries(_turns(spark, sf_dir).select("doc_id", "seq", "role").distinct())


@query(f"""WITH t AS (SELECT conv_id AS doc_id, {ROLE} AS role, text FROM conversations) SELECT doc_id, role, count(*) AS n_units, CAST(sum(len({_all('text', tx.COUNTED_WORD)})) AS BIGINT) AS n_words FROM t WHERE role <> 'loose' OR doc_id NOT IN (SELECT doc_id FROM t WHERE role = 'header') GROUP BY doc_id, role""")
def text_units_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and bullets, and loose lines of what has no header."""
    turns = _turns(spark, sf_dir)
    loose = turns.where("role = 'loose'").join(turns.where("role = 'header'").select("doc_id").distinct(), "doc_id", "left_anti")
    units = turns.where("role <> 'loose'").unionByName(loose)
    return units.groupBy("doc_id", "role").agg(F.count("*").alias("n_units"), F.sum(tx.word_count(F.col("text"))).alias("n_words"))


FLAGSHIP = "scorecard"
MOST = {k: m for of in scoring.most(RULES).values() for k, m in of.items()}
PARTS = [k for of in scoring.most(RULES).values() for k in of]


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole score of every text, read as one section of bullets: one scan of the lines, one of the words."""
    found = structure.structured(structure.plain_documents(_texts(spark, sf_dir)), loose=True, headings=False)
    lines = structure.placed_lines(found, "blob", "name", *structure.GEOMETRY)
    spelt = spelling.score(_unknown(spark, sf_dir)).select("doc_id", "n_red", "n_yellow")
    whole = facts.document_facts(lines, STANDARD, TERMS, RULES).join(spelt, "doc_id", "left").fillna(0, ["n_red", "n_yellow"])
    return scoring.scores(whole, RULES)


def _hit(term: str) -> str:
    if term.isalpha():
        return f"list_contains(ws, {_q(term)})"
    if " " in term or "/" in term:
        return f"contains(lo, {_q(term)})"
    return f"regexp_matches(lo, {_q('(?:^|[^a-z])' + tx.any_of([term]) + '(?:$|[^a-z])')})"


ERF = "t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))"
SCALE = repr(MOST["action_oriented"] / RULES["impact.action_oriented"]) + "::DOUBLE"
_MEAN = lambda kind, n: f"(1.0::DOUBLE * {kind}_strong + 0.92::DOUBLE * {kind}_standard + 0.35::DOUBLE * {kind}_weak + 0.0::DOUBLE * {kind}_none) / {n}"
_COMP = lambda c: f"round_even(6.0::DOUBLE * least(1.0::DOUBLE, coalesce(u_{c}, 0) / 5.0::DOUBLE) / 0.5::DOUBLE, 0) * 0.5::DOUBLE"
CARD_SQL = f"""{LINES_SQL}, l2 AS (SELECT doc_id, line_no, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM lines WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
lb AS (SELECT *, {BODY} AS body FROM l2), kept AS (SELECT * FROM lb WHERE length(regexp_replace(body, '[^A-Za-z0-9]', '', 'g')) >= 2), {BULLETS}, {TIER_SQL}, {TEXTS_SQL}, {_spell('texts').replace('sx AS (SELECT word FROM', 'sx AS (SELECT sp.word FROM')},
ba AS (SELECT doc_id, count(*) AS n_bullets, count(*) FILTER (NOT detail) AS n_plain, {', '.join(f"count(*) FILTER (NOT detail AND tier = '{t}') AS n_{t}, count(*) FILTER (tier = '{t}') AS all_{t}" for t in ("strong", "standard", "weak", "none"))} FROM tiers GROUP BY doc_id),
bs AS (SELECT doc_id, count(*) FILTER ({_numbers('body')} > 0) AS n_q, count(*) FILTER (len({_tools('body')}) > 0) AS n_t, count(*) FILTER ({_passive()}) AS n_p FROM {_tok('bul', 'body')} GROUP BY doc_id),
bv AS (SELECT doc_id, count(*) AS n_units, CAST(sum({_filler('body')}) AS BIGINT) AS n_f, CAST(sum({_pronouns('body')}) AS BIGINT) AS n_r FROM {_tok('lb', 'body')} GROUP BY doc_id),
{_over('lb', 'body')}, bo AS (SELECT doc_id, least(count(*), 2) AS shown FROM flagged GROUP BY doc_id),
bf AS (SELECT doc_id, bool_or(regexp_matches(text, '^[•●▪◦‣⁃·■○∙](?:$|[\\sA-Za-z0-9])') AND NOT regexp_matches(text, '^[•●▪]') OR regexp_matches(text, '^[-–—*o>]\\s') AND NOT regexp_matches(text, '^[-–—]\\s*\\d')) AS odd,
  count(*) FILTER (len({_all('body', tx.COUNTED_WORD)}) >= 4) AS prose, count(*) FILTER (len({_all('body', tx.COUNTED_WORD)}) >= 4 AND regexp_matches(body, '[.!?]\\s*$')) AS ended FROM kept GROUP BY doc_id),
bd AS (SELECT doc_id, bool_or(regexp_matches(text, {_q(tx.REFERENCES)})) AS refs, bool_or(regexp_matches(text, {_q(facts.DATE_BEARING)}) AND regexp_matches(text, {_q(facts.EXPECTED_LIKE)}) AND NOT regexp_matches(text, {_q(facts.MONTH_YEAR_OK)})) AS odd_date FROM l2 GROUP BY doc_id),
br AS (SELECT doc_id, count(*) FILTER (colour = 'red') AS n_red FROM r GROUP BY doc_id),
ct AS (SELECT doc_id, lower(body) AS lo, regexp_split_to_array(lower(body), '[^a-z]+') AS ws FROM lb),
cu AS (SELECT doc_id, {', '.join(f"CAST({' + '.join(f'max(CASE WHEN {_hit(t)} THEN 1 ELSE 0 END)' for t in ts)} AS INTEGER) AS u_{c}" for c, ts in TERMS.items())} FROM ct GROUP BY doc_id),
ps AS (SELECT doc_id,
  greatest(0.0::DOUBLE, least(12.0::DOUBLE, 12.0::DOUBLE * CASE WHEN n_plain > 0 THEN {_MEAN('n', 'n_plain')} WHEN n_bullets > 0 THEN {_MEAN('all', 'n_bullets')} ELSE 0.0::DOUBLE END)) * {SCALE} AS action_oriented,
  coalesce(greatest(0.0::DOUBLE, least(12.0::DOUBLE, 12.0::DOUBLE * (0.5::DOUBLE * least(1.0::DOUBLE, n_q::DOUBLE / n_bullets / 0.6::DOUBLE) + 0.5::DOUBLE * least(1.0::DOUBLE, n_t::DOUBLE / n_bullets / 0.15::DOUBLE) - least(0.25::DOUBLE, n_p::DOUBLE / n_bullets * 0.5::DOUBLE)))), 0.0::DOUBLE) * {SCALE} AS specifics,
  CASE WHEN coalesce(n_units, 0) = 0 THEN 0.0::DOUBLE ELSE 8.0::DOUBLE - 8.0::DOUBLE * least(1.0::DOUBLE, coalesce(shown, 0) / 6.0::DOUBLE) END * {SCALE} AS overuse,
  CASE WHEN coalesce(n_units, 0) = 0 THEN 0.0::DOUBLE ELSE 8.0::DOUBLE - 8.0::DOUBLE * least(1.0::DOUBLE, 0.6::DOUBLE * least(1.0::DOUBLE, n_f / 16.0::DOUBLE) + 0.4::DOUBLE * least(1.0::DOUBLE, n_r / 8.0::DOUBLE)) END * {SCALE} AS avoided_words,
  0.0::DOUBLE AS extracurriculars,
  CASE WHEN coalesce(odd, false) OR coalesce(ended, 0) > 0 AND ended < prose OR coalesce(refs, false) OR coalesce(odd_date, false) THEN 0.0::DOUBLE ELSE 16.0::DOUBLE END AS overall_format,
  1.0::DOUBLE AS number_of_pages, 0.0::DOUBLE AS essential_sections, 0.0::DOUBLE AS section_specific, greatest(0.0::DOUBLE, 3.0::DOUBLE - coalesce(n_red, 0)) AS spell_check,
  {', '.join(f'{_COMP(c)} AS {c}' for c in TERMS)}
  FROM texts LEFT JOIN ba USING (doc_id) LEFT JOIN bs USING (doc_id) LEFT JOIN bv USING (doc_id) LEFT JOIN bo USING (doc_id) LEFT JOIN bf USING (doc_id) LEFT JOIN bd USING (doc_id) LEFT JOIN br USING (doc_id) LEFT JOIN cu USING (doc_id)),
sums AS (SELECT *, 0.0::DOUBLE + action_oriented + specifics + overuse + avoided_words + extracurriculars AS impact, 0.0::DOUBLE + overall_format + number_of_pages + essential_sections + section_specific + spell_check AS presentation, 0.0::DOUBLE + {' + '.join(TERMS)} AS competencies FROM ps),
total AS (SELECT *, round_even(impact + presentation + competencies, 1) AS overall FROM sums),
z AS (SELECT *, (overall - 70.0::DOUBLE) / 14.0::DOUBLE AS z FROM total), x AS (SELECT *, abs(z) / 1.4142135623730951::DOUBLE AS x FROM z), t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM x),
cards AS (SELECT doc_id, {', '.join(PARTS)}, impact, presentation, competencies, overall, CASE WHEN overall < 33 THEN 'red' WHEN overall < 86 THEN 'yellow' ELSE 'green' END AS zone,
  round_even(100 * (0.5::DOUBLE * (1 + sign(z) * (1 - {ERF.replace('0.254829592', '0.254829592::DOUBLE')} * exp(-x * x)))), 1) AS percentile FROM t)"""


@query(f"WITH {CARD_SQL} SELECT * FROM cards")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, the three modules, the score out of 100, its zone and its percentile."""
    return scoring.wide(_cards(spark, sf_dir), PARTS)


@query(f"WITH {CARD_SQL} SELECT zone, count(*) AS n, min(overall) AS lowest, max(overall) AS highest FROM cards GROUP BY zone")
def zone_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard(spark, sf_dir).groupBy("zone").agg(F.count("*").alias("n"), F.min("overall").alias("lowest"), F.max("overall").alias("highest"))


FIND_SQL = f"""{CARD_SQL}, f AS ({' UNION ALL '.join(f"SELECT doc_id, {n} AS seq, '{p}' AS part, {MOST[p]!r}::DOUBLE - {p} AS lost, {MOST[p]!r}::DOUBLE AS most FROM cards" for n, p in enumerate(PARTS))}),
found AS (SELECT *, CASE WHEN lost > 0.5::DOUBLE * most THEN 'error' WHEN lost > 0.01::DOUBLE THEN 'warn' ELSE 'good' END AS severity FROM f)"""


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.findings(scorecard(spark, sf_dir), MOST)


@query(f"""WITH {FIND_SQL} SELECT doc_id, CAST(rank AS INTEGER) AS rank, part, severity, lost FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lost DESC, CASE severity WHEN 'error' THEN 0 ELSE 1 END, seq) AS rank FROM found WHERE lost > 0.01::DOUBLE AND severity <> 'good') WHERE rank <= 10""")
def top_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.top_actions(_losses(spark, sf_dir))


@query(f"""WITH {FIND_SQL}, cl AS (SELECT doc_id, seq, 1.0::DOUBLE + seq AS claim, round_even(sum(lost) OVER (PARTITION BY doc_id), 6) AS deficit FROM found)
SELECT doc_id, seq, claim, deficit, CASE WHEN deficit <= 0 THEN 0.0::DOUBLE ELSE round_even(claim * deficit / sum(claim) OVER (PARTITION BY doc_id), 3) END AS lost FROM cl""")
def reconcile_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of weight 1, 2 and so on, on what a document has lost in all."""
    from pyspark.sql import Window

    claims = _losses(spark, sf_dir).select("doc_id", "seq", (1.0 + F.col("seq")).alias("claim"), F.bround(F.sum("lost").over(Window.partitionBy("doc_id")), 6).alias("deficit"))
    return scoring.reconcile(claims)


@query(f"""WITH {CARD_SQL}, s AS (SELECT lang AS name, overall FROM cards JOIN documents USING (doc_id))
SELECT name, count(*) AS n, avg(overall) AS mean, CASE WHEN stddev_pop(overall) = 0 THEN 1.0::DOUBLE ELSE stddev_pop(overall) END AS stdev, median(overall) AS median, min(overall) AS min, max(overall) AS max FROM s GROUP BY name HAVING count(*) >= 2""")
def cohort_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cohort(scorecard(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), "lang")


def _avoided_of(sql_table: str, key: str) -> str:
    return f"(SELECT {key} AS key, 8.0::DOUBLE - 8.0::DOUBLE * least(1.0::DOUBLE, 0.6::DOUBLE * least(1.0::DOUBLE, {_filler('text')} / 16.0::DOUBLE) + 0.4::DOUBLE * least(1.0::DOUBLE, {_pronouns('text')} / 8.0::DOUBLE)) AS points FROM {_tok(sql_table)})"


@query(f"""WITH d AS (SELECT *, coalesce(b.points, 0.0::DOUBLE) AS before, coalesce(a.points, 0.0::DOUBLE) AS after FROM {_avoided_of('documents', 'doc_id')} b FULL JOIN {_avoided_of('benchmark', 'item_id')} a USING (key))
SELECT key, before, after, after - before AS change FROM d WHERE abs(after - before) > 0.05::DOUBLE""")
def score_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The avoided-words points of documents against those of the benchmark items of the same number."""
    of = lambda name, key: impact.avoided(table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "points")
    return scoring.difference(of("documents", "doc_id"), of("benchmark", "item_id"), ["key"])


@query("SELECT CAST(i AS BIGINT) AS score, exp(-0.5::DOUBLE * pow((i - 70.0::DOUBLE) / 14.0::DOUBLE, 2)) AS density FROM range(101) AS r(i)")
def peer_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.peer_curve(spark)


ROLES = "SELECT o_custkey AS who, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS start_month, CAST(year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 5 AS INTEGER) AS end_month FROM orders"


@query(f"""WITH r AS ({ROLES}), n AS (SELECT *, lead(start_month) OVER (PARTITION BY who ORDER BY start_month, end_month) AS next_start FROM r)
SELECT who, end_month, next_start, next_start - end_month AS gap FROM n WHERE next_start - end_month > 6""")
def timeline_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as roles: they begin in their month and last up to four more."""
    start = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return structure.gaps(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("who"), start.cast("int").alias("start_month"), (start + F.col("o_orderkey") % 5).cast("int").alias("end_month")))


HEADINGS = ["  EDUCATION:  ", "Work Experience", "Research", "Leadership & Activities", "Skills/Interests", "Awards", "Volunteer Work", "My Story", "Coursework —", "", "experience", "Objective", "Papers.", "Hobby", "Honours and Awards", "T ECHNICAL S KILLS", "Clubs and Organizations", "Relevant Project Experience"]


def _headings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k // 4, h) for k, h in enumerate(HEADINGS)], "doc_id long, heading string")


def _key_sql() -> str:
    t = "lower(heading)"
    for pattern in (r"^\s+|\s+$", r"[|:•·\-–—_]+$", r"^\s+|\s+$", r"^[|:•·\-–—_]+", r"^\s+|\s+$", r"[.,;:]+$", r"^\s+|\s+$"):
        t = f"regexp_replace({t}, '{pattern}', '', 'g')"
    return rf"regexp_replace({t}, '\s+', ' ', 'g')"


_NAMES = [(h, c) for c, hs in lx.SECTIONS.items() for h in hs]
HEAD_SQL = f"""h AS (SELECT CAST(d AS BIGINT) AS doc_id, heading FROM (VALUES {', '.join(f"({k // 4}, {_q(h)})" for k, h in enumerate(HEADINGS))}) AS v(d, heading)),
names AS (SELECT heading, canonical, ord, replace(heading, ' ', '') AS s FROM (VALUES {', '.join(f"({_q(h)}, {_q(c)}, {k})" for k, (h, c) in enumerate(_NAMES))}) AS v(heading, canonical, ord)),
exact AS (SELECT heading, arg_max(canonical, ord) AS canonical, min(ord) AS ord FROM names GROUP BY heading),
k AS (SELECT doc_id, heading, {_key_sql()} AS key FROM h), q AS (SELECT *, regexp_replace(lower(key), '[^a-z0-9&]', '', 'g') AS s FROM k),
canon AS (SELECT doc_id, heading, coalesce((SELECT canonical FROM exact WHERE exact.heading = q.key), (SELECT arg_min(canonical, ord) FROM names WHERE names.s = q.s),
  (SELECT arg_min(canonical, ord) FROM exact WHERE q.key <> '' AND (contains(exact.heading, q.key) OR contains(q.key, exact.heading)) AND abs(length(exact.heading) - length(q.key)) <= 6)) AS canonical FROM q)"""


@query(f"WITH {HEAD_SQL} SELECT * FROM canon")
def section_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.canonical(_headings(spark))


@query(f"""WITH {HEAD_SQL}, g AS (SELECT doc_id, bool_or(coalesce(canonical = 'education', false)) AS education, bool_or(coalesce(canonical IN ({lx.quoted(lx.EXPERIENCE_CLASS)}), false)) AS experience, bool_or(coalesce(canonical IN ({lx.quoted(lx.EXTRACURRICULAR)}), false)) AS extracurricular, count(*) FILTER (canonical IS NULL) AS n_unknown, count(*) AS n_sections FROM canon GROUP BY doc_id)
SELECT *, greatest(0.0::DOUBLE, 9.0::DOUBLE - (CASE WHEN education THEN 0 ELSE 4.5::DOUBLE END + CASE WHEN experience THEN 0 ELSE 4.5::DOUBLE END + least(2.0::DOUBLE, 1.0::DOUBLE * n_unknown) + CASE WHEN n_sections >= 9 THEN 1.35::DOUBLE ELSE 0 END)) AS points, CASE WHEN extracurricular THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END AS extra_points FROM g""")
def essential_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.essential(structure.canonical(_headings(spark)))


@query(f"WITH {HEAD_SQL} SELECT doc_id, CASE WHEN count(*) FILTER (canonical IN ({lx.quoted(lx.EXTRACURRICULAR)})) > 0 THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END AS points, coalesce(string_agg(heading, ', ' ORDER BY heading) FILTER (canonical IN ({lx.quoted(lx.EXTRACURRICULAR)})), '') AS sections FROM canon GROUP BY doc_id")
def extracurriculars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points for a section on what lies beside study and work."""
    own = F.when(F.col("canonical").isin(*lx.EXTRACURRICULAR), F.col("heading"))
    found = structure.canonical(_headings(spark)).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(own)), ", ").alias("sections"), F.count(own).alias("n"))
    return found.select("doc_id", F.when(F.col("n") > 0, 6.0).otherwise(0.0).alias("points"), "sections")


STYLES = [("05/2024", "numeric", None), ("12-19", "numeric", None), ("May 2026", "full-month", None), ("December 2027", "full-month", "full"), ("Sept 2021", "abbrev-month", "abbrev"), ("Jan. 2021", "abbrev-month", "abbrev"), ("2019", "year-only", None), ("soon", "other", None)]


@query("SELECT a AS raw, b AS style, c AS month FROM (VALUES " + ", ".join(f"('{a}', '{b}', {'NULL' if c is None else repr(c)})" for a, b, c in STYLES) + ") AS v(a, b, c)")
def date_style_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How given dates are written, and what style their months show, against what the rules make of them."""
    raw = F.col("raw")
    return spark.createDataFrame([(a,) for a, _, _ in STYLES], "raw string").select("raw", structure.date_style(raw).alias("style"), structure.month_style(F.regexp_extract(raw, r"^([A-Za-z]+\.?)", 1)).alias("month"))


#: Words of two small pages, with rows that drift and rows that don't.
WORDS = [(d, 1, k, f"w{d}{k}", 72.0 + 40.0 * (k % 3) + d, 100.0 + 40.0 * (k % 3), 50.0 + 2.0 * (k % 3) + 14.0 * (k // 3) + (1.5 * k if d else 0.0), 60.0 + 14.0 * (k // 3) + (1.5 * k if d else 0.0), 9.0 + (k % 2)) for d in range(2) for k in range(12)]
WORDS_DDL = "doc_id long, page int, word_pos int, text string, x0 double, x1 double, top double, bottom double, size double"
WORDS_SQL = "words AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(page AS INTEGER) AS page, CAST(word_pos AS INTEGER) AS word_pos, text, x0::DOUBLE AS x0, x1::DOUBLE AS x1, top::DOUBLE AS top, bottom::DOUBLE AS bottom, size::DOUBLE AS size FROM (VALUES " + ", ".join(str(w) for w in WORDS) + ") AS v(doc_id, page, word_pos, text, x0, x1, top, bottom, size))"


def _words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WORDS, WORDS_DDL)


@query(f"WITH {WORDS_SQL}, b AS (SELECT doc_id, page, min(x0) AS l, max(x1) AS r, min(top) AS t, max(bottom) AS b FROM words GROUP BY ALL) SELECT doc_id, page, l AS left_margin, 612.0::DOUBLE - r AS right_margin, t AS top_margin, 792.0::DOUBLE - b AS bottom_margin, least(greatest((b - t) / (792.0::DOUBLE - t), 0.0::DOUBLE), 1.0::DOUBLE) AS fill_ratio FROM b")
def page_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark)
    return layout.margins(words, words.select("doc_id", "page").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)}))


@query(f"""WITH RECURSIVE {WORDS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, size) AS rn FROM words),
f AS (SELECT doc_id, page, word_pos, rn, top AS anchor, size AS s FROM o WHERE rn = 1 UNION ALL
  SELECT o.doc_id, o.page, o.word_pos, o.rn, CASE WHEN o.top - f.anchor > greatest(2.6::DOUBLE, 0.3::DOUBLE * f.s) THEN o.top ELSE f.anchor END, CASE WHEN o.top - f.anchor > greatest(2.6::DOUBLE, 0.3::DOUBLE * f.s) THEN o.size ELSE f.s END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.rn = f.rn + 1),
p AS (SELECT words.*, anchor AS row_top FROM words JOIN f USING (doc_id, page, word_pos)),
m AS (SELECT doc_id, page, row_top, first(s ORDER BY n DESC, s) AS size FROM (SELECT doc_id, page, row_top, round(size, 1) AS s, count(*) AS n FROM p GROUP BY ALL) GROUP BY ALL),
b AS (SELECT doc_id, page, row_top, string_agg(text, ' ' ORDER BY x0, word_pos) AS text, min(x0) AS x0, max(x1) AS x1, min(top) AS top, max(bottom) AS bottom FROM p GROUP BY doc_id, page, row_top)
SELECT doc_id, page, text, x0, x1, top, bottom, size, coalesce(top - lag(bottom) OVER w, 0.0::DOUBLE) AS space_above, CAST(row_number() OVER w - 1 AS INTEGER) AS line_no FROM b JOIN m USING (doc_id, page, row_top) WINDOW w AS (PARTITION BY doc_id, page ORDER BY row_top)""")
def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(_words(spark))


@query(f"""WITH RECURSIVE {WORDS_SQL}, v AS (SELECT DISTINCT doc_id, x0 FROM words), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY x0) AS rn FROM v),
f AS (SELECT doc_id, rn, x0 AS anchor, 1 AS n FROM o WHERE rn = 1 UNION ALL SELECT o.doc_id, o.rn, CASE WHEN x0 - anchor > 3 THEN x0 ELSE anchor END, n + CASE WHEN x0 - anchor > 3 THEN 1 ELSE 0 END FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1)
SELECT doc_id, CAST(max(n) AS INTEGER) AS n_clusters, max(n) <= 1 AS passed FROM f GROUP BY doc_id""")
def indent_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.indent_clusters(_words(spark).select("doc_id", F.col("x0").alias("indent")))


@query(f"WITH {WORDS_SQL}, s AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, word_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM words) SELECT doc_id, page, reach AS gap_from, x0 AS gap_to FROM s WHERE x0 > reach")
def gutter_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.gutters(_words(spark))


STEMS = [("plan", "DG"), ("study", "SD"), ("box", "S"), ("cat", "")]
AFFIXES = [("D", "", "ned", "n"), ("D", "y", "ied", "[^aeiou]y"), ("G", "", "ning", "n"), ("S", "y", "ies", "[^aeiou]y"), ("S", "", "es", "[sxzh]")]


@query(f"""WITH s AS (SELECT * FROM (VALUES {', '.join(str(s) for s in STEMS)}) AS v(word, flags)), r AS (SELECT * FROM (VALUES {', '.join(str(r) for r in AFFIXES)}) AS v(flag, strip, plus, condition)),
e AS (SELECT word, unnest(string_split(flags, '')) AS flag FROM s)
SELECT word FROM s UNION SELECT substr(word, 1, length(word) - length(strip)) || plus FROM e JOIN r USING (flag) WHERE regexp_matches(word, '(?:' || condition || ')$') AND ends_with(word, strip)""")
def affix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.affix_forms(spark.createDataFrame(STEMS, "word string, flags string"), spark.createDataFrame(AFFIXES, "flag string, strip string, add string, condition string"))


DATED = [(1, 0, "Jun - Aug 2017"), (1, 1, "Sept 2020 - Present"), (1, 2, "Expected May 2027"), (1, 3, "2019"), (1, 4, "Jan 2018 to March 2019, then May 2020"), (1, 5, "no date"), (1, 6, "June-August 2017"), (1, 7, "Sep 2023 – now"), (1, 8, "1999 - 2001 and 2003")]
#: line, kind, what it says, expected, bad abbreviation, spaced, first and last month counted from year 0.
DATES = [
    (0, "range", "Jun - Aug 2017", False, False, True, 24210, 24212), (1, "range", "Sept 2020 - Present", False, True, True, 24249, 119988), (2, "month", "May 2027", True, False, True, 24329, 24329),
    (3, "year", "2019", False, False, True, 24229, 24240), (4, "range", "Jan 2018 to March 2019", False, False, True, 24217, 24231), (4, "month", "May 2020", False, False, True, 24245, 24245),
    (6, "range", "June-August 2017", False, False, False, 24210, 24212), (7, "range", "Sep 2023 – now", False, False, True, 24285, 119988), (8, "range", "1999 - 2001", False, False, True, 23989, 24024),
]


@query("SELECT 1::BIGINT AS doc_id, CAST(a AS INTEGER) AS line_no, b AS kind, c AS raw, d AS expected, e AS bad_abbreviation, f AS spaced, CAST(g AS INTEGER) AS start_month, CAST(h AS INTEGER) AS end_month FROM (VALUES " + ", ".join(f"({a}, '{b}', '{c}', {d}, {e}, {f}, {g}, {h})" for a, b, c, d, e, f, g, h in DATES) + ") AS v(a, b, c, d, e, f, g, h)")
def date_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of given lines, against what the rules make of them, worked out by hand."""
    return structure.date_spans(spark.createDataFrame(DATED, "doc_id long, line_no int, text string"))


NAMES = ("analytical", "communication", "leadership", "teamwork", "initiative")


GRAM = "[a-z0-9][a-z0-9+&'/-]*"
_PAIRS = "list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])"


@query(f"""WITH {LINES_SQL}, b AS (SELECT DISTINCT unnest(list_concat(regexp_extract_all(lower(text), '[a-z]{{4,}}'), {_PAIRS})) AS term FROM (SELECT text, {_all('lower(text)', GRAM)} AS ws FROM benchmark)), terms AS (SELECT term, [{lx.quoted(NAMES)}][length(term) % 5 + 1] AS competency FROM b),
t AS (SELECT DISTINCT doc_id, line_no, unnest(list_concat(ws, {_PAIRS})) AS term FROM (SELECT doc_id, line_no, {_all('lower(text)', GRAM)} AS ws FROM lines)),
g AS (SELECT doc_id, competency, count(DISTINCT line_no) AS n_lines, count(DISTINCT term) AS n_terms FROM t JOIN terms USING (term) GROUP BY ALL),
p AS (SELECT *, round_even(6.0::DOUBLE * least(1.0::DOUBLE, n_terms / 5.0::DOUBLE) / 0.5::DOUBLE, 0) * 0.5::DOUBLE AS points FROM g)
SELECT *, CASE WHEN points >= 5 THEN 'Good Job!' WHEN points >= 2.5 THEN 'On Track!' ELSE 'Needs Work!' END AS status FROM p""")
def competency_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of four letters or more and pairs of words of the benchmark stand in for the terms, dealt to competencies by their length."""
    low = F.lower("text")
    every = F.concat(F.regexp_extract_all(low, F.lit("[a-z]{4,}"), F.lit(0)), F.filter(competencies.grams(F.regexp_extract_all(low, F.lit(GRAM), F.lit(0)), 2), lambda g: g.contains(" ")))
    words = table(spark, sf_dir, "benchmark").select(F.explode(every).alias("term")).distinct()
    terms = words.select("term", F.element_at(F.array(*map(F.lit, NAMES)), F.length("term") % 5 + 1).alias("competency"))
    return competencies.points(competencies.found(_lines(spark, sf_dir), terms, 2))


PROFILE = [("references", 0), ("ending", 1), ("length", 2)]


@query(f"""WITH {LINES_SQL}, {KEPT}, d AS (SELECT doc_id, NOT bool_or(regexp_matches(text, {_q(tx.REFERENCES)})) AS a, bool_and(regexp_matches(text, '[.!?]\\s*$')) OR NOT bool_or(regexp_matches(text, '[.!?]\\s*$')) AS b, count(*) <= 40 AS c FROM kept GROUP BY doc_id)
SELECT doc_id, 'references' AS name, 0 AS ord, a AS passed FROM d UNION ALL SELECT doc_id, 'ending', 1, b FROM d UNION ALL SELECT doc_id, 'length', 2, c FROM d""")
def profile_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a document, those of a profile only, in its order."""
    text = F.col("text")
    ended = text.rlike(r"[.!?]\s*$")
    made = impact.kept_lines(_lines(spark, sf_dir)).groupBy("doc_id").agg((~F.bool_or(text.rlike(tx.REFERENCES))).alias("references"), (F.bool_and(ended) | ~F.bool_or(ended)).alias("ending"), (F.count("*") <= 40).alias("length"), F.lit(True).alias("unused"))
    checks = made.select("doc_id", F.explode(F.create_map(*(x for n in ("references", "ending", "length", "unused") for x in (F.lit(n), F.col(n))))).alias("name", "passed"))
    return checks.join(F.broadcast(spark.createDataFrame(PROFILE, "name string, ord int")), "name").select("doc_id", "name", "ord", "passed")


@query(f"WITH {CARD_SQL} SELECT doc_id, printf('%5.1f', overall) || ' ' || repeat('#', CAST(floor(overall / 5) AS INTEGER)) || repeat('.', 20 - CAST(floor(overall / 5) AS INTEGER)) || ' ' || zone AS line FROM cards")
def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.floor(F.col("overall") / 5).cast("int")
    return scorecard(spark, sf_dir).select("doc_id", F.concat(F.format_string("%5.1f", "overall"), F.lit(" "), F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), 20 - filled), F.lit(" "), F.col("zone")).alias("line"))


@query(f"SELECT name, n, mean, stdev, median, min, max FROM ({ORACLES['cohort_stats']})")
def public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a cohort that may be shown."""
    stats = cohort_stats(spark, sf_dir)
    return stats.select(*(c for c in scoring.PUBLIC if c in stats.columns))

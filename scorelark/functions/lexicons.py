"""Word lists of the scoring rules.

Lists that results depend on are stated here as they are. Lists of more entries
(everyday verbs, competency terms, spelling vocabulary, seniority titles) are
parameters: ``terms`` reads them from text files, and the operators take them
as arguments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: they must be these for right results ----

STRONG_VERBS = """
accelerate architect automate champion consolidate convert cut decrease deliver double drive eliminate engineer
expand expedite generate grow increase initiate innovate institute launch maximize minimize modernize negotiate
optimize orchestrate outperform overhaul pioneer quantify rearchitect rebuild redesign reduce reengineer restructure
revamp save scale secure shape slash spearhead standardize streamline strengthen surpass transform triple
unify win accelerated capture close found merge prototype resolve salvage turnaround validate yield
own owned rank replace rearchitected halve quadruple outpace unblock de-risk harden instrument
productionize operationalize monetize commercialize land ship exceed beat rescue recover reclaim
decouple parallelize vectorize cache index compress amplify boost elevate propel spark
seed bootstrap cofound co-found incubate arbitrate broker underwrite syndicate raise fund
achieve attain realize clinch earn unlock
""".split()

WEAK_VERBS = """
aid assist attend attempt contribute cover deal engage experience familiarize follow get give go
handle help involve join keep learn look make observe participate provide put receive serve shadow
showcase take try use utilize volunteer work
""".split()

IRREGULAR_PAST = dict(pair.split(":") for pair in """
led:lead built:build wrote:write written:write taught:teach grew:grow grown:grow won:win drove:drive driven:drive
sold:sell spoke:speak chose:choose held:hold kept:keep sent:send brought:bring bought:buy caught:catch cut:cut
set:set put:put made:make met:meet paid:pay saw:see took:take gave:give found:find began:begin begun:begin
rose:rise fell:fall spent:spend left:leave told:tell ran:run oversaw:oversee overseen:oversee rewrote:rewrite
outgrew:outgrow rebuilt:rebuild redid:redo undertook:undertake withdrew:withdraw shrank:shrink struck:strike
swept:sweep thought:think understood:understand upheld:uphold dealt:deal drew:draw flew:fly forecast:forecast
got:get gotten:get knew:know known:know shown:show showed:show spread:spread stood:stand
""".split())  # fmt: skip

NOUN_PHRASE_OPENERS = (
    "market research", "data analysis", "data entry", "poster presentation", "customer service", "team member",
    "project management", "quality assurance", "process improvement", "financial analysis", "business development",
    "social media", "event planning", "research assistant", "office administration", "sales support",
    "inventory management", "risk assessment", "content creation", "product management", "supply chain", "front desk",
    "help desk", "lab work", "field work", "case study", "cost analysis", "report writing", "code review",
    "software development", "web development", "machine learning", "guest lecture", "study group", "peer tutoring",
    "community outreach",
)
NON_VERB_OPENERS = (
    "responsible for", "responsibilities included", "duties included", "duties involved", "tasked with",
    "in charge of", "was responsible", "worked as", "role involved", "job involved", "position involved", "helped to",
    "part of a team", "member of a team", "my role", "this role", "successfully completed",
)

FILLER_ADVERBS = """
successfully effectively efficiently actively independently significantly substantially greatly highly very really
extremely quite truly basically essentially literally definitely certainly simply just also additionally
furthermore moreover consistently constantly continuously proactively diligently carefully closely properly
""".split()
BUZZWORDS = (
    "synergy", "synergies", "leverage", "leveraging", "go-getter", "guru", "ninja", "rockstar", "wizard",
    "thought leader", "results-driven", "detail-oriented", "self-starter", "team player", "hard worker", "hard-working",
    "motivated", "passionate", "dynamic", "seasoned", "value-add", "best-in-class", "world-class", "cutting-edge",
    "outside the box",
)
VAGUE_QUANTIFIERS = (
    "various", "several", "numerous", "many", "multiple", "some", "few", "different", "certain", "assorted",
    "countless", "lots", "plenty", "a number of", "a variety of", "wide range", "wide variety",
)
ARTICLES = ("the", "have")
FIRST_PERSON = "i me my mine myself we us our ours ourselves you your yours".split()
PRONOUNS = (*FIRST_PERSON, *"he him his she her hers they them their theirs it its".split())
PRONOUN_PHRASES = ("i am", "i was", "i will", "i have", "i had", "i can", "i would", "my own", "we are", "we were", "we will", "we have")
WEASEL_PHRASES = (
    "such as", "in order to", "as well as", "along with", "due to the fact", "with the goal of", "for the purpose of",
    "in the process of", "was able to", "were able to", "had the opportunity to", "including but", "on a daily basis",
    "on a regular basis", "as needed", "when necessary",
)

BE_VERBS = "am is are was were be been being get got".split()
IRREGULAR_PARTICIPLES = """
given taken written chosen driven shown known grown seen done made built sent kept held led run brought bought
taught caught found won put set spent told left met read paid sold beaten broken spoken awarded selected assigned
promoted hired tasked
""".split()
#: Words that are never counted as overused, besides pronouns and articles.
STOPWORDS = """
of to in for on with by at from as and or into over across per via using used was were is are be been being have has
had
""".split()
#: Verbs that count as overused.
COMMON_VERBS = "analyze analyse provide develop support build".split()
SPELLED_NUMBERS = """
one two three four five six seven eight nine ten eleven twelve fifteen twenty thirty forty fifty hundred thousand
million billion dozen several-hundred first second third fourth fifth half double triple
""".split()

TOOLS = (
    "python", "r", "sql", "java", "c++", "javascript", "matlab", "sas", "stata", "scala", "julia", "excel", "tableau",
    "power bi", "looker", "pandas", "numpy", "scikit-learn", "tensorflow", "pytorch", "spark", "hadoop", "airflow",
    "dbt", "snowflake", "aws", "azure", "gcp", "docker", "kubernetes", "git", "linux", "bash", "algorithm",
    "machine learning", "deep learning", "nlp", "computer vision", "optimization", "simulation", "modeling", "model",
    "pipeline", "etl", "database", "api", "automation", "script", "dashboard",
)

#: canonical section: headings that name it. Of a heading in two sections the exact form names the last, the form without blanks the first.
SECTIONS = {
    "education": ("education", "academic background", "academics", "educational background", "education & training", "education and training"),
    "experience": (
        "experience", "work experience", "professional experience", "relevant experience", "employment",
        "employment history", "work history", "industry experience", "internship experience", "internships",
        "professional background", "career history", "relevant work experience", "relevant professional experience",
        "related experience", "research experience", "research", "academic research experience and projects",
        "academic and research projects", "research and academic projects", "academic research projects",
        "engineering experience", "technical experience", "additional experience", "other experience",
    ),
    "leadership": (
        "leadership & activities", "leadership and activities", "leadership", "activities", "leadership experience",
        "extracurricular activities", "extracurriculars", "campus involvement", "involvement",
        "activities & leadership", "activities and leadership", "leadership & involvement", "co-curriculars",
        "cocurriculars", "involvement experience", "involvement and leadership", "student involvement",
        "campus activities", "activities and involvement", "leadership and involvement", "organizations",
        "clubs and organizations",
    ),
    "skills": (
        "skills", "technical skills", "skills & interests", "skills and interests", "core competencies",
        "technical proficiencies", "proficiencies", "additional skills", "skills, activities & interests", "tools",
        "technologies", "technical expertise",
    ),
    "projects": (
        "projects", "selected projects", "technical projects", "academic projects", "personal projects",
        "project experience", "portfolio", "relevant project experience", "relevant projects", "research projects",
        "design projects", "engineering projects", "academic project experience", "course projects",
    ),
    "research": ("research", "research experience", "research projects"),
    "awards": (
        "awards", "honors", "honours", "awards & honors", "awards and honors", "honors & awards", "honours and awards",
        "achievements", "honors and awards", "distinctions", "scholarships", "honors and distinctions",
        "awards and recognition",
    ),
    "publications": ("publications", "papers", "presentations & publications"),
    "certifications": ("certifications", "certificates", "licenses", "licenses & certifications", "licences and certifications", "credentials"),
    "coursework": ("relevant coursework", "coursework", "selected coursework", "courses"),
    "volunteer": ("volunteer", "volunteer experience", "community service", "community involvement", "service", "volunteer work", "community engagement"),
    "interests": ("interests", "hobbies", "personal interests"),
    "summary": (
        "summary", "professional summary", "objective", "career objective", "profile", "about me", "personal statement",
        "summary of qualifications", "qualifications", "qualifications summary", "highlights of qualifications",
        "professional profile", "career summary",
    ),
    "languages": ("languages", "language skills"),
}
ESSENTIAL = ("education", "experience")
#: Any of these stands for experience.
EXPERIENCE_CLASS = ("experience", "projects", "volunteer")
DISCOURAGED = ("summary", "interests")
EXTRACURRICULAR = ("leadership", "awards", "volunteer", "publications")
#: Headings that are better written with an ampersand.
AMPERSAND = {
    "leadership and activities": "Leadership & Activities", "activities and leadership": "Activities & Leadership",
    "skills and interests": "Skills & Interests", "awards and honors": "Awards & Honors",
    "honors and awards": "Honors & Awards", "education and training": "Education & Training",
}
#: Level: titles that show it.
SENIORITY = {
    1: ("volunteer", "shadow", "observer", "trainee", "apprentice"),
    2: ("intern", "internship", "co-op", "coop", "assistant", "aide", "student", "tutor", "ambassador", "clerk"),
    3: (
        "analyst", "associate", "coordinator", "specialist", "developer", "engineer", "designer", "consultant",
        "researcher", "technician", "representative", "teaching assistant", "research assistant",
    ),
    4: ("senior", "sr", "lead", "supervisor", "manager", "captain", "president", "chair", "head", "principal", "staff"),
    5: ("director", "founder", "co-founder", "cofounder", "chief", "ceo", "cto", "coo", "cfo", "partner", "vp", "vice president", "owner"),
}
SPOKEN_LANGUAGES = """
english mandarin chinese cantonese spanish french german italian portuguese russian arabic hebrew hindi urdu bengali
punjabi tamil telugu marathi gujarati japanese korean vietnamese thai indonesian malay tagalog filipino turkish persian
farsi polish czech slovak hungarian romanian bulgarian serbian croatian bosnian slovenian greek dutch flemish swedish
danish norwegian finnish icelandic ukrainian belarusian latvian lithuanian estonian albanian macedonian swahili yoruba
igbo hausa amharic somali zulu afrikaans nepali sinhala burmese khmer lao mongolian kazakh uzbek azerbaijani armenian
georgian catalan basque galician welsh irish gaelic maltese latin
""".split()
#: Spellings of the Commonwealth that pass.
COMMONWEALTH = """
honours honour honoured colour colours coloured favour favours favoured favourite behaviour behaviours labour labours
neighbour endeavour endeavours rumour harbour flavour armour vapour saviour valour organisation organisations
organisational organise organised organising specialise specialised specialising specialisation analyse analysed
analysing recognise recognised recognising prioritise prioritised prioritising optimise optimised optimising utilise
utilised utilising maximise maximised minimise minimised standardise standardised summarise summarised emphasise
emphasised categorise categorised digitise digitised modernise modernised realise realised apologise authorise
authorised characterise computerise centre centres centred theatre metre metres litre litres kilometre kilometres fibre
calibre sombre programme programmes licence licences defence offence practise practised pretence travelled travelling
traveller modelling modelled labelled labelling cancelled cancelling counselled counselling enrolled enrolment
fulfilment instalment skilful wilful judgement acknowledgement ageing learnt spelt burnt dreamt amongst whilst towards
catalogue catalogues dialogue dialogues analogue cheque cheques storey storeys grey sceptical aluminium cosy moustache
plough draught tyre
""".split()
#: Words that are always, and never, reported as unknown.
ALWAYS_UNKNOWN, NEVER_UNKNOWN = ("definer", "duffing"), ("lifecycle", "lifecycles")
#: Endings and beginnings that make words of words, the longer tried first.
SUFFIXES = """
ability ibility ization isation ations ation ments ment ness ings ing ers er ors or ies es ed s al ly able ible ised
ized ising izing
""".split()
BEGINNINGS = "micro macro multi non pre post re sub super inter intra over under auto co semi anti cross mid meta mini hyper ultra de un bi tri".split()
#: Glyph numbers that parsers leave behind, and what they stand for.
GLYPH_NUMBERS = {
    127: "•", 149: "•", 8226: "•", 8259: "⁃", 183: "·", 9679: "●", 9642: "▪", 9702: "◦", 8211: "–", 8212: "—",
    8217: "’", 8216: "‘", 8220: "“", 8221: "”",
}

GLYPHS = "•●▪◦‣⁃·■○∙-–—*o>"
AMBIGUOUS_GLYPHS = "-–—*o>"
MONTHS = "january february march april may june july august september october november december".split()
MONTHS_SHORT = [m[:3] for m in MONTHS]
#: Months as a style: May is spelled alike in both.
FULL_MONTHS = [m for m in MONTHS if m != "may"]
ABBREVIATED_MONTHS = [*(m for m in MONTHS_SHORT if m != "may"), "sept"]
COMPETENCIES = {"analytical": "Analytical", "communication": "Communication", "leadership": "Leadership", "teamwork": "Teamwork", "initiative": "Initiative"}
BAD_MONTHS = ("sept", "sept.", "jan.", "feb.", "mar.", "apr.", "jun.", "jul.", "aug.", "sep.", "oct.", "nov.", "dec.", "june.", "july.")

# ---- end of the fixed values ----


def terms(spark: SparkSession, path: str) -> DataFrame:
    """The distinct terms of text files, one a line, lower-cased: column ``term``."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).where("term <> ''").distinct()


def quoted(words) -> str:
    """The words as a list of SQL literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)

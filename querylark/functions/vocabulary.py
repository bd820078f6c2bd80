"""Word lists, rules and weights of query understanding, passages and answers.

Fixed values: answers depend on them, so they are stated as they have to be. Entries of one or more words are
matched as substrings of lower-cased text unless a function says otherwise; blanks around an entry don't count.
"""

from __future__ import annotations


def _list(text: str) -> list[str]:
    return [w.strip() for line in text.strip().splitlines() for w in line.split(",") if w.strip()]


#: Properties in their order: ties between equal scores go to the earlier one.
PROPERTIES = ["LOCATION", "COMPARISON", "TIME", "ADVANTAGES", "LIMITATIONS", "USAGE", "FUNCTION", "COMPOSITION", "HISTORY", "DEFINITION"]
WEIGHTS = dict(zip(PROPERTIES, [3.0, 3.0, 3.0, 2.5, 2.5, 2.5, 2.0, 2.0, 1.5, 1.5]))

# Fixed values -----------------------------------------------------------------------------------------------------
QUERY_SIGNALS = {
    "LOCATION": _list("locat, where, capital, coast, close to, near, geograph, region, country, continent, border"),
    "COMPARISON": _list("vs, versus, compare, difference, better, worse, than, between, relative"),
    "TIME": _list("when, year, date, century, invented, introduced, created, period, era"),
    "ADVANTAGES": _list("advantage, benefit, strength, pro, why is, important, significant, popular, widely"),
    "LIMITATIONS": _list("limitation, drawback, disadvantage, weakness, con, challenge, problem, issue, risk, costly"),
    "USAGE": _list("used for, use case, beginner, start with, recommend, suitable, learning, best for, application"),
    "FUNCTION": _list("how does, how do, mechanism, ensures, works, process, protocol, function, method, operates"),
    "COMPOSITION": _list("composed, consist, made of, component, type, kind, part, element, structure"),
    "HISTORY": _list("history, origin, founded, century, heritage, evolved, developed, introduced, ancient, medieval"),
    "DEFINITION": _list("what is, what are, define, definition, meaning, concept, overview, explain"),
}
CHUNK_TYPES = ["LOCATION", "ADVANTAGES", "LIMITATIONS", "USAGE", "FUNCTION", "DEFINITION", "PERSON", "TEMPORAL", "PROCEDURE", "HISTORY"]
CHUNK_SIGNALS = {
    "LOCATION": _list("located, coast, archipelago, built across, connected to, situated, eastern, western, southern, northern, island nation, port city"),
    "ADVANTAGES": _list("advantage, benefit, strength, why is, still widely, widely used, proven, mature ecosystem, important for, important because"),
    "LIMITATIONS": _list("limitation, drawback, disadvantage, weakness, not suitable, lack of, vendor lock"),
    "USAGE": _list("used for, use case, suitable for, application, beginner, start with, recommend, learning path"),
    "FUNCTION": _list("ensures, mechanism, how does, how do, three-way, handshake, retransmit, flow control, congestion, checksum"),
    "DEFINITION": _list("is a, is an, refers to, defined as, are organized, collection of, aims to, studies how"),
    "PERSON": _list("born, inventor, founded by, created by, alan turing, charles babbage, ada lovelace, blaise pascal"),
    "TEMPORAL": _list("century, 1642, 1947, 1990, ancient, early, modern computing, evolution, emerged, invented, year, 1960, 1970, 1980, 1989, 1991, 1995, 2000"),
    "PROCEDURE": _list("step, how to, procedure, process, algorithm, method, technique"),
    "HISTORY": _list("history, heritage, medieval, centuries, political, economic center, founded, origin, developed, introduced, first described, first practical, first released"),
}
CAPITAL_WORDS = _list("capital")
CAPITAL_CONTEXT = _list("island, city, region, country, bridge, port, sea, lake, coast, located")
VALIDATION = {
    "LOCATION": _list("located, capital, coast, city, region, sea, island, eastern, western, southern, northern, situated, built"),
    "DEFINITION": _list("is a, is an, refers to, defined, means, collection, system, organized, capital, largest, known for, known as"),
    "ADVANTAGES": _list("advantage, benefit, strength, widely, proven, reliable, powerful, mature, important, significant, leading, major"),
    "LIMITATIONS": _list("limitation, drawback, disadvantage, lack, not suitable, weaker, costly, vendor"),
    "FUNCTION": _list("ensures, mechanism, works, provides, handles, protocol, process, control"),
    "USAGE": _list("used for, use case, beginner, start with, recommend, suitable, learning"),
    "HISTORY": _list("history, founded, century, origin, developed, introduced, heritage"),
    "TIME": _list("year, century, date, period, invented, introduced, created"),
    "COMPARISON": _list("vs, compare, difference, better, worse, more, less, affordable"),
}
LOCATION_WORDS = _list("located, coast, eastern, western, southern, northern, situated, built across, latitude, longitude")
LOCATION_NOUNS = _list("sea, ocean, lake, river, island, peninsula, region, border, strait")
LOCATION_COMPARE = _list("located, coast, eastern, situated, sea, lake, island")
LOCATION_PENALTIES = _list("important, nobel, museum, cultural, startup, tech hub, green area, nature park, ferry, airport")
DEFINITION_PATTERNS = _list("is a, is an, is the, capital, known for, refers to, defined as")
DEFINITION_PENALTIES = _list("expensive, rent, cost, salary, startup, tech hub, ranking, ranks, ecosystem, important for, important because")
DEFINITION_SEGMENT_PATTERNS = _list("is a, is an, is the, refers to, defined as, known for, known as, collection of, organized")
DEFINITION_SEGMENT_PENALTIES = _list("expensive, rent, cost, salary, startup, tech hub, ranking, ranks")
BOOSTS = {
    "ADVANTAGES": _list("advantage, benefit, strength, widely, proven, mature, standardiz, reliable, powerful, important, significant, leading, major, innovation"),
    "LIMITATIONS": _list("limitation, drawback, disadvantage, lack, not suitable, weaker, less mature, vendor lock, costly"),
    "USAGE": _list("used for, use case, beginner, start with, recommend, suitable, learning path, best for"),
    "HISTORY": _list("history, origin, founded, century, developed, introduced, evolved, heritage"),
    "COMPARISON": _list("vs, compare, difference, better, worse, more, less, affordable, expensive, cheaper"),
}
HISTORY_SIGNALS = _list("history, founded, century, centuries, origin, heritage, medieval, political")
STOP_WORDS = _list("""
a, an, the, is, are, was, were, be, been, being, have, has, had, do, does, did, will, would, shall, should, may, might, must, can, could
i, me, my, we, our, you, your, he, she, it, they, them, their, this, that, these, those, what, which, who, whom, how, when, where, why
not, no, nor, but, and, or, if, then, so, at, by, for, with, about, from, to, in, on, of, as, into, through, during, before, after
above, below, between, out, off, over, under, again, further, once, here, there, all, each, every, both, few, more, most, other, some, such
than, too, very, just, also, tell, explain, describe, define, show, please""")
NO_ENTITIES = _list("""
important, famous, popular, useful, good, bad, better, worse, best, worst, great, large, small, scalable, reliable, fast, slow, cheap, expensive
suitable, mainstream, widely, still, connected, limitation, limitations, advantage, advantages, benefit, benefits, drawback, drawbacks
overview, difference, comparison, beginner, beginners, works, work, ensures, ensure, functions, operates, uses, provides, supports, requires
allows, enables, compared, related, based, called, known, used""")
CLAUSE_TRIGGERS = _list("where, what, why, how, when, who, also, tell")
STRICT_HINTS = _list("brief, short, quick, just")
EXPANDED_HINTS = _list("in detail, explain, overview, describe, comprehensive, thorough")
EXPLANATION_HINTS = _list("explain, describe, how, why")
SUMMARY_HINTS = _list("overview, tell me about, summarize")
#: (property, property of the support need, its form, its keywords)
SELF_ASK = [
    ("ADVANTAGES", "DEFINITION", "SHORT_FACT", ["definition"]),
    ("ADVANTAGES", "LOCATION", "SHORT_FACT", ["located", "region"]),
    ("COMPARISON", "DEFINITION", "SHORT_FACT", ["definition"]),
    ("LIMITATIONS", "USAGE", "EXPLANATION", ["used for", "application"]),
    ("HISTORY", "TIME", "SHORT_FACT", ["year", "century"]),
    ("HISTORY", "DEFINITION", "SHORT_FACT", ["definition"]),
    ("FUNCTION", "DEFINITION", "SHORT_FACT", ["definition"]),
]
#: property -> properties that are answered before it
DEPENDENCIES = {"HISTORY": ["LOCATION"], "ADVANTAGES": ["LOCATION", "DEFINITION"], "FUNCTION": ["DEFINITION"], "LIMITATIONS": ["DEFINITION"], "COMPARISON": ["DEFINITION"], "USAGE": ["DEFINITION"]}
PREFERRED_TYPES = {
    "LOCATION": ["LOCATION", "GENERAL"],
    "DEFINITION": ["DEFINITION", "LOCATION", "GENERAL"],
    "TIME": ["TEMPORAL", "HISTORY"],
    "HISTORY": ["HISTORY", "TEMPORAL"],
    "FUNCTION": ["FUNCTION", "PROCEDURE", "DEFINITION"],
    "COMPOSITION": ["DEFINITION", "GENERAL"],
    "USAGE": ["USAGE", "PROCEDURE", "GENERAL"],
    "ADVANTAGES": ["ADVANTAGES", "GENERAL"],
    "LIMITATIONS": ["LIMITATIONS", "GENERAL"],
    "COMPARISON": ["ADVANTAGES", "LIMITATIONS", "GENERAL"],
}
PRIMARY_TYPE = {"LOCATION": "LOCATION", "DEFINITION": "DEFINITION", "TIME": "TEMPORAL", "HISTORY": "HISTORY", "FUNCTION": "FUNCTION", "USAGE": "USAGE", "ADVANTAGES": "ADVANTAGES", "LIMITATIONS": "LIMITATIONS"}
DEFAULT_FORM = {"COMPARISON": "COMPARISON", "COMPOSITION": "LIST", "ADVANTAGES": "LIST", "LIMITATIONS": "LIST", "USAGE": "LIST", "FUNCTION": "EXPLANATION", "HISTORY": "EXPLANATION", "LOCATION": "SHORT_FACT", "TIME": "SHORT_FACT"}
DOMAINS = _list("""
east, west, north, south, eastern, western, northern, southern, coast, sea, lake, river, ocean, island, border, capital, continent, peninsula
sweden, europe, asia, pacific, atlantic, baltic, located, situated
database, sql, nosql, relational, distributed, protocol, tcp, network, internet, encryption, algorithm, scalable, efficient, complexity
blockchain, decentralized, consensus, python, programming, interpreted, compiled
energy, electric, solar, renewable, fossil, battery, voltage, current, photovoltaic, antibiotic, bacteria, resistance, penicillin
climate, greenhouse, carbon, temperature, planet, mars, orbit, atmosphere
inflation, price, economy, gdp, debt, interest, monetary, fiscal, currency""")
NEGATIONS = _list("not, no, never, neither, without, lack, cannot, unable, impossible")
OPPOSITES = [tuple(p.split("|")) for p in "east|west eastern|western north|south northern|southern increase|decrease rising|falling advantage|disadvantage benefit|drawback cheap|expensive fast|slow safe|dangerous reliable|unreliable efficient|inefficient simple|complex".split()]
#: (words before the entity, words after it, intent, answer type)
TEMPLATES = [
    ("where is", "", "FACTUAL", "LOCATION"), ("where is", "located", "FACTUAL", "LOCATION"), ("what country is", "in", "FACTUAL", "LOCATION"),
    ("what is", "", "FACTUAL", "DEFINITION"), ("what is a", "", "FACTUAL", "DEFINITION"), ("what are", "", "FACTUAL", "DEFINITION"), ("define", "", "FACTUAL", "DEFINITION"),
    ("who is", "", "FACTUAL", "PERSON_PROFILE"), ("who was", "", "FACTUAL", "PERSON_PROFILE"), ("who invented", "", "FACTUAL", "PERSON_PROFILE"), ("who created", "", "FACTUAL", "PERSON_PROFILE"),
    ("when was", "invented", "FACTUAL", "TEMPORAL"), ("when was", "created", "FACTUAL", "TEMPORAL"), ("when did", "happen", "FACTUAL", "TEMPORAL"), ("what year was", "invented", "FACTUAL", "TEMPORAL"),
    ("how does", "work", "EXPLANATION", "PROCEDURE"), ("how do", "work", "EXPLANATION", "PROCEDURE"), ("how to use", "", "PROCEDURAL", "PROCEDURE"),
    ("explain", "", "EXPLANATION", "SUMMARY"), ("describe", "", "EXPLANATION", "SUMMARY"), ("tell me about", "", "GENERAL", "SUMMARY"), ("difference between", "and something", "COMPARISON", "COMPARISON"),
]
#: answer type of a question -> (property, form) of its need; others are GENERAL, SUMMARY
ANSWER_TYPES = {"LOCATION": ("LOCATION", "SHORT_FACT"), "DEFINITION": ("DEFINITION", "SUMMARY"), "TEMPORAL": ("TIME", "SHORT_FACT"), "COMPARISON": ("COMPARISON", "COMPARISON"), "PROCEDURE": ("FUNCTION", "EXPLANATION"), "PERSON_PROFILE": ("HISTORY", "SUMMARY")}
#: property -> answer type (others SUMMARY), and form -> intent (others GENERAL)
TYPE_OF_PROPERTY = {"LOCATION": "LOCATION", "DEFINITION": "DEFINITION", "TIME": "TEMPORAL", "COMPARISON": "COMPARISON", "FUNCTION": "PROCEDURE"}
INTENT_OF_FORM = {"SHORT_FACT": "FACTUAL", "EXPLANATION": "EXPLANATION", "COMPARISON": "COMPARISON"}

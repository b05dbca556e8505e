"""Domain packs: the word lists and patterns that jobs take as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pack:
    patterns: tuple[tuple[str, str], ...]  # (entity type, pattern)
    lexicon: dict[str, str]  # phrase -> entity type
    topics: dict[str, tuple[str, tuple[str, ...], str]] = field(default_factory=dict)  # id -> title, terms, guidance
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)  # trigger -> phrases
    hints: dict[str, tuple[str, ...]] = field(default_factory=dict)  # community -> words of a question
    stopwords: tuple[str, ...] = ()
    global_markers: tuple[str, ...] = ()
    multi_hop_markers: tuple[str, ...] = ()
    community_markers: tuple[str, ...] = ()
    case_markers: tuple[str, ...] = ()
    court: str = ""
    date: str = ""
    months: str = ""
    citation_in_question: str = r"\b\d+\s+[A-Z][A-Za-z. ]+\s+\d+\b"
    name_in_question: str = r"\b[A-Z][A-Za-z.']+\s+v\.\s+[A-Z][A-Za-z.']+"


# Fixed values of the legal pack: patterns, lexicon, topics, aliases, hints, markers and stop words.
_CASE = r"\b[A-Z][A-Za-z0-9.'&-]+(?:\s+[A-Z][A-Za-z0-9.'&-]+){0,5}\s+v\.\s+[A-Z][A-Za-z0-9.'&-]+(?:\s+[A-Z][A-Za-z0-9.'&-]+){0,6}"
_CITATION = (
    r"\b\d+\s+(?:F\.?\s?(?:Supp\.?\s?\d*d?|2d|3d)?|U\.S\.|S\.?\s?Ct\.|P\.?\s?\d*d?|N\.?E\.?\s?\d*d?|"
    r"S\.?W\.?\s?\d*d?|N\.?W\.?\s?\d*d?|Mass\.|Idaho|Ohio|OK\s+CR)\s+\d+\b"
)
_STATUTE = r"(?i)\b(?:\d+\s+U\.S\.C\.?\s*(?:§|section)?\s*[\w.()-]+|\d+\s+O\.S\.[^,;.]{0,40}|\d+\s+C\.F\.R\.?\s*[\w.()-]+)\b"
_COURT = (
    r"\b(?:United States\s+)?(?:Supreme Court|Court of Appeals|District Court|Court of Criminal Appeals|Court of Appeal|"
    r"Supreme Judicial Court)(?:\s+(?:of|for|at)\s+[A-Z][A-Za-z .'-]+)?"
)
_JUDGE = r"\b(?:Judge|Justice|J\.)\s+[A-Z][A-Za-z.'-]+"

LEGAL = Pack(
    patterns=(("CASE", _CASE), ("CITATION", _CITATION), ("LAW", _STATUTE), ("ORG", _COURT), ("PERSON", _JUDGE)),
    lexicon={
        "abuse of discretion": "CONCEPT", "administrative procedure": "CONCEPT", "certificate of appealability": "CONCEPT",
        "collateral attack": "CONCEPT", "constitutional": "CONCEPT", "contract": "CONCEPT", "de novo": "CONCEPT",
        "double jeopardy": "CONCEPT", "due process": "CONCEPT", "equal protection": "CONCEPT", "evidentiary ruling": "CONCEPT",
        "fifth amendment": "LAW", "fourteenth amendment": "LAW", "fourth amendment": "LAW", "harmless error": "CONCEPT",
        "habeas corpus": "CONCEPT", "ineffective assistance": "CONCEPT", "intellectual property": "CONCEPT",
        "jurisdiction": "CONCEPT", "miranda": "LAW", "post-conviction": "CONCEPT", "procedural default": "CONCEPT",
        "qualified immunity": "CONCEPT", "reasonable doubt": "CONCEPT", "right to counsel": "LAW", "search and seizure": "LAW",
        "self-incrimination": "LAW", "sixth amendment": "LAW", "sovereign immunity": "CONCEPT", "standard of review": "CONCEPT",
        "strickland": "LAW", "sufficiency of the evidence": "CONCEPT", "waiver": "CONCEPT",
    },
    topics={
        "global_legal_themes": ("Common legal themes across the corpus", ("standard of review", "sufficiency of the evidence", "ineffective assistance", "preservation of error", "harmless error", "procedural default"), ""),
        "global_precedent_reasoning": ("How cited precedents influence legal reasoning", ("precedent", "standard of review", "sufficiency of the evidence", "harmless error", "preservation of error", "procedural default", "de novo", "abuse of discretion"), ""),
        "global_constitutional_rights": ("Constitutional rights raised in criminal and appellate cases", ("fourth amendment", "fifth amendment", "sixth amendment", "fourteenth amendment", "miranda", "search and seizure", "double jeopardy", "self-incrimination", "right to counsel", "due process", "equal protection"), ""),
        "global_court_types": ("Court types represented in the corpus", ("court of appeals", "district court", "supreme court", "supreme judicial court", "court of criminal appeals", "court of appeal"), ""),
        "global_government_civil_cases": ("Civil cases involving government or state agencies", ("sovereign immunity", "qualified immunity", "42 u.s.c", "section 1983", "state agency", "due process", "equal protection", "administrative procedure"), ""),
        "global_civil_disputes": ("Civil dispute types appearing alongside criminal cases", ("contract", "tort", "civil rights", "intellectual property", "trademark", "habeas corpus"), ""),
        "global_procedural_grounds": ("Procedural grounds for denial or dismissal", ("procedural default", "waiver", "jurisdiction", "untimely", "preserve", "certificate of appealability"), ""),
        "global_direct_postconviction_review": ("Direct appeals versus post-conviction or habeas review", ("direct appeal", "post-conviction", "habeas corpus", "collateral attack", "procedural default", "waiver"), ""),
        "global_federal_state_constitutional_review": ("Federal circuit versus state appellate constitutional review", ("court of appeals", "federal circuit", "state appellate", "supreme court", "habeas corpus", "de novo"), ""),
    },
    aliases={
        "constitutional rights": ("fourth amendment", "fifth amendment", "sixth amendment", "fourteenth amendment", "miranda", "search and seizure", "double jeopardy", "self-incrimination", "right to counsel", "due process", "equal protection"),
        "criminal appeal": ("sufficiency of the evidence", "ineffective assistance", "preservation of error", "standard of review", "harmless error"),
        "insufficient evidence": ("sufficiency of the evidence", "rational trier", "reasonable doubt", "light most favorable", "substantial evidence"),
        "government": ("sovereign immunity", "qualified immunity", "42 u.s.c", "section 1983", "state agency", "due process", "equal protection"),
        "civil disputes": ("contract", "tort", "civil rights", "intellectual property", "trademark", "habeas"),
        "procedural": ("procedural default", "waiver", "jurisdiction", "untimely", "preserve", "certificate of appealability"),
        "direct appeals": ("direct appeal", "post-conviction", "postconviction", "habeas corpus", "collateral attack", "cause and prejudice"),
        "standard of review": ("abuse of discretion", "de novo", "clearly erroneous", "substantial evidence", "harmless error"),
        "federal circuit": ("court of appeals", "federal circuit", "state appellate", "supreme court precedent", "habeas corpus", "de novo"),
        "strickland": ("strickland", "ineffective assistance", "objective standard", "reasonable probability", "counsel"),
    },
    hints={
        "global_legal_themes": ("common", "themes", "theme", "criminal", "appeal", "appeals", "precedents", "reasoning"),
        "global_precedent_reasoning": ("precedent", "precedents", "cited", "influence", "reasoning", "standard"),
        "global_constitutional_rights": ("constitutional", "rights", "right", "amendment", "amendments"),
        "global_court_types": ("court", "courts", "represented", "types", "type"),
        "global_government_civil_cases": ("government", "state", "agency", "agencies", "defendants"),
        "global_civil_disputes": ("civil", "disputes", "alongside", "contract", "tort"),
        "global_procedural_grounds": ("procedural", "grounds", "deny", "dismiss", "appeals"),
        "global_direct_postconviction_review": ("direct", "appeals", "post", "conviction", "post-conviction", "relief", "petitions", "habeas", "collateral"),
        "global_federal_state_constitutional_review": ("federal", "circuit", "state", "appellate", "constitutional", "questions", "differently"),
    },
    stopwords=("about", "across", "after", "also", "case", "cases", "cited", "court", "decided", "does", "from", "have", "into", "legal", "opinion", "opinions", "that", "the", "their", "these", "this", "what", "when", "where", "which", "with"),
    global_markers=("across", "common", "corpus", "frequent", "frequently", "patterns", "represented", "types"),
    multi_hop_markers=("affect", "against", "cited", "differently", "distinguish", "influence", "multi", "precedents", "standard", "strickland"),
    community_markers=("cited precedents", "precedents influence", "court's reasoning", "courts reasoning", "direct appeals", "post-conviction", "post conviction", "relief petitions", "federal circuit", "state appellate", "constitutional questions"),
    case_markers=("court of criminal appeals", "criminal appeal", "post-conviction", "convicted", "conviction", "defendant", "sentence"),
    court=_COURT,
    date=r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}\b",
    months=r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\b",
)

#: Stop words of flat retrieval (fixed values).
FLAT_STOPWORDS = ("about", "across", "after", "also", "case", "court", "decided", "does", "from", "have", "how", "into", "legal", "opinion", "opinions", "that", "the", "their", "these", "this", "what", "when", "where", "which", "with")
#: Stop words of lexical scores (fixed values).
SCORE_STOPWORDS = ("a", "an", "and", "are", "as", "by", "for", "from", "in", "is", "of", "or", "the", "to", "was", "with")

#: A pack for general prose, for corpora without legal language.
PROSE = Pack(
    patterns=(("NUMBER", r"[0-9]{2,}"), ("NAME", r"[A-Z][a-z]+ [A-Z][a-z]+"), ("EMAIL", r"[a-z0-9._]+@[a-z0-9.]+")),
    lexicon={"the": "WORD", "and": "WORD", "that": "WORD", "with": "WORD", "this": "WORD", "der": "WORD", "que": "LINK", "for": "LINK"},
    topics={"global_words": ("Frequent words", ("the", "with", "absent"), ""), "global_links": ("Frequent links", ("que", "for", "der"), "Links join words.")},
    aliases={"the": ("thing", "other"), "with": ("within",), "of that": ("that", "than")},
    hints={"global_words": ("thed", "anded", "tion"), "global_links": ("ining", "with")},
    stopwords=("that", "with", "from"),
    global_markers=("this", "whonen", "onen"),
    multi_hop_markers=("tioning", "oned", "rest"),
    community_markers=("ing the", "er the"),
    case_markers=("thing", "ation", "ered"),
    court=r"[A-Z][a-z]+ [A-Z][a-z .]+",
    date=r"[0-9]{2,}",
    months=r"[0-9]{2,}",
    citation_in_question=r"[0-9]+ [A-Z][a-z]+ [0-9]+",
    name_in_question=r"[A-Z][a-z]+ v[.] [A-Z][a-z]+",
)

"""Parameters of the registered queries: a lexicon and rules of words that the provided tables hold."""

from __future__ import annotations

from ..operators.stance import Lexicon

LEXICON = Lexicon(
    tough=[(2.0, ["with this"]), (1.5, ["from", "by"]), (1.0, ["was"])],
    cooperate=[(2.0, ["of the"]), (1.5, ["with", "for"]), (1.0, ["are"])],
    negation=["no", "as"],
    strong=["that"],
    weak=["at"],
    tough_modals=["is"],
    cooperate_modals=["be"],
)
ROWS = [("tough" if c == 0 else "cooperate", w, k) for c, _, w, k in LEXICON.rows()]

TIER_ONE, TIER_TWO, OVERLAY = ["with this", "of the"], ["from", "with", "are"], ["that", "this", "there"]
WHITE, BLACK, PHRASES = ["from", "with", "for", "and", "the"], ["ththe", "enen"], ["of the", "in the", "to the"]
SUBJECT, TERMS = ["that", "this"], ["from", "with", "for", "are", "was", "by"]
TOPICS = [("alpha", ["with this", "from"]), ("beta", ["of the", "are"]), ("gamma", ["que", "est"]), ("delta", ["und", "der"])]
STRONG = {"with this", "of the"}
INSTITUTIONS = [("first", ["src1"]), ("second", ["src2", "src3"]), ("third", ["src7"])]
SEGMENTS = [("tagged", ["ref=", "utm_"], 3), ("listing", ["Page="], 1), ("titled", ["the", "und"], 4), ("tenth", ["10"], 3), ("early", ["3", "5"], 2)]
KINDS = [("report", ["/en/"]), ("decision", ["/fr/", "/de/"])]

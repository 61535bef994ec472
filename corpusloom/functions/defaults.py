"""Default lexicons and maps. Every operator takes its lexicon as a parameter; these are the ones to use unchanged."""

from __future__ import annotations

from ..operators.stance import Lexicon

# Fixed values, in the order in which they are tried: they must be what they are for results to agree.
TOUGH = [
    (2.0, [
        "de-risk", "de-risking", "decoupling", "decouple",
        "systemic rival", "systemic rivalry",
        "strategic competitor", "strategic competition",
        "security threat", "threat to security",
        "strategic dependency", "strategic dependence",
        "economic coercion", "economic coercive",
        "level playing field", "reciprocity", "reciprocal",
        "weaponize interdependence", "weaponisation of interdependence",
        "economic security", "supply chain resilience",
        "foreign subsidy", "strategic autonomy",
        "trade defence", "trade defense",
        "derisking strategy",
    ]),
    (1.5, [
        "anti-dumping", "anti dumping", "antidumping",
        "countervailing duty", "countervailing measure",
        "anti-subsidy", "anti subsidy", "antisubsidy",
        "export control", "export restriction",
        "investment screening", "investment review",
        "sanction", "restriction", "restrictive",
        "barrier", "tariff", "ban",
        "safeguard measure", "safeguard investigation",
        "trade remedy", "trade remedies",
        "market access barrier", "market access restriction",
        "forced technology transfer", "forced transfer of technology",
        "circumvention", "circumvent",
        "dumping", "subsidy", "investigation",
        "countermeasure", "retaliation", "retaliatory",
        "surveillance", "screening mechanism",
        "critical infrastructure",
        "dependency reduction", "reducing dependence",
    ]),
    (1.0, [
        "unfair competition", "unfair trade",
        "market distortion", "distortion", "distortive",
        "overcapacity", "excess capacity",
        "discriminatory", "discrimination", "discriminate",
        "non-compliant", "noncompliance", "non compliance",
        "predatory pricing", "state subsidy",
        "intellectual property theft", "IP theft",
        "imbalanced trade", "trade imbalance",
        "trade deficit", "market protection",
        "state-owned enterprise", "SOE",
        "industrial overcapacity",
        "unfair trade practice", "origin fraud",
    ]),
]
COOPERATE = [
    (2.0, [
        "win-win", "win win",
        "mutual benefit", "mutually beneficial",
        "strategic partnership", "comprehensive strategic partnership",
        "shared governance", "common development",
        "multilateral cooperation", "multilateral collaboration",
        "shared interest", "common interest",
        "partnership agreement", "comprehensive agreement",
        "economic integration", "rules-based order",
        "constructive engagement", "strategic trust",
    ]),
    (1.5, [
        "cooperation", "cooperate", "cooperative",
        "collaboration", "collaborate", "collaborative",
        "dialogue", "consultation", "consult",
        "negotiation", "negotiate", "negotiating",
        "trade agreement", "free trade agreement",
        "joint initiative", "joint effort",
        "working group", "bilateral summit",
        "green cooperation", "digital cooperation",
        "engagement", "partnership",
        "memorandum of understanding", "MoU",
        "high-level dialogue", "technical cooperation",
        "capacity building", "exchange",
        "joint statement", "coordinated approach",
        "investment agreement", "economic dialogue",
    ]),
    (1.0, [
        "open market", "market opening",
        "mutual respect", "respectful",
        "complementary", "complementarity",
        "inclusive", "inclusiveness",
        "mutual understanding",
        "transparency", "predictability",
        "harmonization", "harmonisation", "harmonize",
        "alignment", "align", "aligned",
        "convergence", "converge",
        "facilitation", "facilitate",
        "liberalization", "liberalisation",
    ]),
]
NEGATION = [
    "not", "no", "hardly", "never",
    "without", r"lack\s+of", r"fail(?:ed|s|ing)?\s+to",
    "neither", "nor", r"absence\s+of",
    r"does\s+not", r"do\s+not", r"did\s+not",
    "cannot", r"can\s+not", r"will\s+not",
    r"unable\s+to", r"refuse(?:s|d)?\s+to",
]
STRONG_CONTRAST = ["but", "however", "nevertheless", "nonetheless", "yet", "instead"]
WEAK_CONTRAST = ["while", "although", "though", "whereas", "despite", r"in\s+spite\s+of"]
TOUGH_MODALS = ["must", "should", r"need\s+to", r"have\s+to", r"has\s+to", r"required\s+to", r"obliged\s+to", "shall"]
COOPERATE_MODALS = ["can", "could", "may", "might", r"willing\s+to", r"ready\s+to", r"possible\s+to"]
STANCE = Lexicon(TOUGH, COOPERATE, NEGATION, STRONG_CONTRAST, WEAK_CONTRAST, TOUGH_MODALS, COOPERATE_MODALS)

TRADE_TERMS = [
    "trade", "critical raw material", "semiconductor", "electric vehicle",
    "renewable energy", "steel", "market access", "digital trade",
    "subsidy", "anti-subsidy", "anti-dumping", "tariff",
    "investment screening", "fdi", "intellectual property", "ip",
    "carbon border adjustment", "cbam", "industrial policy",
]
SUBJECT_TERMS = ["china", "chinese"]
EXCLUDED_TITLES = [r"\bhong\s*kong\b", r"\bmacau\b", r"\bmacao\b", r"\btaiwan\b", r"\btaipei\b", r"\bchinese\s*taipei\b"]
INSTITUTIONS = [
    ("欧委会", ["commission"]),
    ("欧盟理事会", ["council"]),
    ("欧洲议会", ["parliament"]),
    ("DG TRADE", ["trade"]),
    ("EEAS", ["eeas"]),
    ("EEAS", ["external action"]),
    ("欧委会", ["committee"]),
    ("欧委会", ["directorate"]),
]
DOCUMENT_TYPES = [
    ("条例", ["regulation"]),
    ("决议", ["decision"]),
    ("报告", ["report"]),
    ("白皮书", ["white paper"]),
    ("声明", ["declaration"]),
    ("报告", ["communication"]),
    ("决议", ["recommendation"]),
    ("条例", ["directive"]),
    ("声明", ["notice"]),
    ("报告", ["proposal"]),
    ("报告", ["opinion"]),
]
TOPICS = [
    ("半导体", ["semiconductor", "chip", "microchip", "processor", "microelectronics"]),
    ("新能源", ["renewable energy", "solar", "wind", "hydrogen", "clean energy", "photovoltaic", "battery", "electric vehicle", "ev"]),
    ("钢铁", ["steel", "aluminium", "aluminum", "metal"]),
    ("市场准入", ["market access", "public procurement", "government procurement"]),
    ("数字贸易", ["digital trade", "data flow", "data localisation", "digital economy", "e-commerce"]),
    ("补贴调查", ["subsidy", "anti-subsidy", "state aid", "foreign subsidy", "countervailing", "anti-dumping"]),
    ("关税", ["tariff", "duty", "mfn", "gsp", "generalised scheme", "countervailing"]),
    ("投资审查", ["investment screening", "fdi", "foreign direct investment", "investment control"]),
    ("知识产权", ["intellectual property", "patent", "trademark", "copyright", "trade secret", "technology transfer"]),
]
OTHER = "其他"

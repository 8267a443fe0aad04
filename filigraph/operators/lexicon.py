"""The rules of extraction. Every table here is a default that callers replace by their own."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Mission sentences, tried in order on lower-case text.
MISSION_PATTERNS = (
    r"(?:our\s+)?mission\s+(?:is\s+)?(?:to\s+)?([^.]+\.)",
    r"(?:our\s+)?purpose\s+(?:is\s+)?(?:to\s+)?([^.]+\.)",
    r"we\s+(?:are\s+)?(?:committed|dedicated)\s+to\s+([^.]+\.)",
    r"(?:our\s+)?goal\s+is\s+to\s+([^.]+\.)",
)
#: Initiatives, in order.
INITIATIVE_PATTERNS = (
    r"(?:launched|introduced|implemented|expanded)\s+(?:our\s+|the\s+)?([A-Z][^,.]+)",
    r"(?:our\s+)?([A-Z][A-Za-z+\s]+(?:platform|program|initiative|service|membership))",
)
#: Keywords by objective type, in order.
OBJECTIVES = {
    "growth": ("expand", "grow", "increase market", "scale", "enter new market"),
    "innovation": ("innovat", "research and development", "r&d", "technology leadership", "artificial intelligence", "machine learning"),
    "cost_leadership": ("cost efficien", "low cost", "price leadership", "operational efficien"),
    "diversification": ("diversif", "new segment", "portfolio expansion"),
    "sustainability": ("sustainab", "environmental", "carbon", "renewable", "ESG"),
}
#: Capabilities, in order.
CAPABILITIES = (
    "supply chain", "logistics", "digital platform", "cloud", "artificial intelligence", "data analytics", "manufacturing",
    "distribution network", "e-commerce", "technology infrastructure", "research and development", "brand management",
)
#: Keywords by risk category, in order.
RISKS = {
    "macro": ("inflation", "economic", "recession", "interest rate", "currency"),
    "regulatory": ("regulat", "compliance", "government", "legal", "legislation"),
    "competitive": ("competi", "market share", "pricing pressure"),
    "supply_chain": ("supply chain", "logistics", "inventory", "supplier"),
    "technology": ("cybersecurity", "cyber", "data breach", "technology risk"),
    "operational": ("workforce", "labor", "operational risk", "disruption"),
}


@dataclass(frozen=True)
class Lexicon:
    """Patterns and keywords by kind, and how many of each kind a document keeps."""

    missions: tuple[str, ...] = MISSION_PATTERNS
    initiatives: tuple[str, ...] = INITIATIVE_PATTERNS
    objectives: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(OBJECTIVES))
    capabilities: tuple[str, ...] = CAPABILITIES
    risks: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(RISKS))
    most_objectives: int = 4
    most_capabilities: int = 5
    most_initiatives: int = 3
    most_risks: int = 5

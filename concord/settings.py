"""Thresholds, weights, blocking specs and fixed value lists, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

# fixed values: legal suffixes that name cleaning strips, by feed
SUFFIXES = {
    "crm": r"\s*(,\s*)?(Inc\.?|LLC\.?|Corp\.?|Co\.?|Ltd\.?|L\.?P\.?|L\.?L\.?C\.?|P\.?C\.?)\s*$",
    "claims": r"\s*(,\s*)?(Inc\.?|LLC\.?|Corp\.?|Co\.?|Ltd\.?|L\.?P\.?|L\.?L\.?C\.?)\s*$",
    "credentialing": r"\s*(,\s*)?(Inc\.?|LLC\.?|Corp\.?|Co\.?|Ltd\.?|L\.?P\.?|L\.?L\.?C\.?|P\.?C\.?)\s*$",
    "cms_reference": r"\s*(,\s*)?(Inc\.?|LLC\.?|Corp\.?|Co\.?|Ltd\.?)\s*$",
}

# fixed values: name abbreviations
ABBREVIATIONS = {
    "BCBS": "BLUE CROSS BLUE SHIELD",
    "BC": "BLUE CROSS",
    "BS": "BLUE SHIELD",
    "UHC": "UNITEDHEALTHCARE",
    "UHG": "UNITEDHEALTH GROUP",
    "HCSC": "HEALTH CARE SERVICE CORPORATION",
    "KP": "KAISER PERMANENTE",
    "KFHP": "KAISER FOUNDATION HEALTH PLAN",
    "HMO": "HEALTH MAINTENANCE ORGANIZATION",
    "PPO": "PREFERRED PROVIDER ORGANIZATION",
    "EPO": "EXCLUSIVE PROVIDER ORGANIZATION",
    "POS": "POINT OF SERVICE",
    "MVP": "MVP HEALTH CARE",
    "HAP": "HEALTH ALLIANCE PLAN",
    "PHP": "PHYSICIANS HEALTH PLAN",
    "QHP": "QUALIFIED HEALTH PLAN",
    "FEHB": "FEDERAL EMPLOYEES HEALTH BENEFITS",
    "CCHP": "CHINESE COMMUNITY HEALTH PLAN",
}

# fixed values: address words left out of token comparison
ADDRESS_STOPS = ["ST", "STREET", "AVE", "AVENUE", "BLVD", "BOULEVARD", "RD", "ROAD", "DR", "DRIVE", "LN", "LANE", "CT", "COURT", "STE", "SUITE", "APT", "UNIT", "FL", "FLOOR", "#"]

# fixed values: postal abbreviations
POSTAL = {
    "STREET": "ST",
    "AVENUE": "AVE",
    "BOULEVARD": "BLVD",
    "ROAD": "RD",
    "DRIVE": "DR",
    "LANE": "LN",
    "COURT": "CT",
    "PLACE": "PL",
    "CIRCLE": "CIR",
    "TERRACE": "TER",
    "NORTH": "N",
    "SOUTH": "S",
    "EAST": "E",
    "WEST": "W",
    "NORTHEAST": "NE",
    "NORTHWEST": "NW",
    "SOUTHEAST": "SE",
    "SOUTHWEST": "SW",
    "SUITE": "STE",
    "APARTMENT": "APT",
}

# fixed values: US states
STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE",
    "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA",
    "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN",
    "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM",
    "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA",
    "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA",
    "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}

UNIFIED = (
    "source_record_id source_system source_id payor_name payor_name_clean payor_name_alt tax_id npi cms_plan_id address_line_1 address_line_2 city "
    "state_code zip_code zip_plus_4 phone website payor_type line_of_business parent_ref is_active effective_date termination_date source_trust_rank loaded_at"
).split()


@dataclass(frozen=True)
class Settings:
    auto_match: float = 0.85
    review: float = 0.60
    weights: dict[str, float] = field(default_factory=lambda: {"name": 0.35, "tax": 0.25, "address": 0.20, "phone": 0.10, "cms": 0.10})
    blocking: tuple[str, ...] = ("block_name_key", "block_tax_id", "block_zip3_name4")


DEFAULT = Settings()

"""Code lists of the questionnaire: label of each code, in display order."""

# Fixed values throughout this module.

DISABILITY = {"0": "Non-disabled", "1": "Disabled"}

EDUCATION = {
    "0": "No formal education",
    "1": "Informal schooling only",
    "2": "Less than primary education",
    "3": "Primary school completed",
    "4": "Lower secondary school completed",
    "5": "Upper secondary school completed",
    "6": "Post-secondary non-tertiary education",
    "8": "Bachelor/equivalent degree completed",
    "9": "Masters/equivalent degree or above",
    "98": "Don't know",
    "99": "Prefer not to respond",
}

YES_NO = {"Yes": 1.0, "No": 0.0}

HEALTH_REASONS = {
    "HACC04_1": "Health facility too far",
    "HACC04_2": "Medicine or health facility too expensive",
    "HACC04_3": "No treatment exists/Not necessary",
    "HACC04_4": "Don't know where to go",
    "HACC04_5": "No time",
    "HACC04_6": "Prefer other options",
    "HACC04_7": "Health facility does not accept new patients",
    "HACC04_8": "Don't trust modern medicine",
    "HACC04_9": "Don't trust doctors",
    "HACC04_10": "Administrative/documentation issues (certificates, service cards, etc.)",
    "HACC04_11": "Long waiting times",
    "HACC04_12": "Lack of medical supplies",
    "HACC04_13": "Health facility damaged/destroyed",
}

IDENTITY_DOCUMENTS = {
    "REG01a": "Passport",
    "REG01b": "Birth certificate",
    "REG01c": "Civil/ government issued ID",
    "REG01d": "Residency permit",
    "REG01e": "Statelessness documentation",
    "REG01f": "Household card of address/family book",
    "REG01g": "Social security card",
    "REG02": "Any other document",
}

IDENTITY_DOCUMENTS_STRATIFIED = {
    "REG01a": "Passport",
    "REG01b": "Birth certificate",
    "REG01c": "National ID card",
    "REG01d": "Residency permit (both temporary and permanent)",
    "REG01e": "Statelessness documentation",
    "REG01f": "Household card of address/family book",
    "REG01g": "Refugee ID/Asylum seekers certificate/ Alien cards",
    "REG01h": "Drivers license",
    "REG01l": "Work permit",
    "REG02": "Any other document",
}

GBV_SERVICES = {
    "GBV01a": "Health services",
    "GBV01b": "Psycho-social services",
    "GBV01c": "safety and security services",
    "GBV01d": "Legal assistance",
}

GBV_SERVICES_STRATIFIED = {**GBV_SERVICES, "GBV01c": "Safety and security services"}

VIOLENCE_QUESTIONS = {
    "VAW01a": "If she goes out without telling him",
    "VAW01b": "If she neglects the children",
    "VAW01c": "If she argues with him",
    "VAW01d": "If she refuses to have sex with him",
    "VAW01e": "If she burns the food",
}

STOVES = {
    "1": "Solar cooker (thermal energy from the sun)",
    "2": "Electric stove",
    "3": "Piped natural gas stove",
    "4": "Biogas stove",
    "5": "Liquefied petroleum gas (LPG)/cooking gas stove",
    "6": "Manufactured solid fuel stove",
    "7": "Traditional solid fuel stove (non-manufactured)",
    "8": "Moveable firepan",
    "9": "Three stone stove/open fire",
    "10": "Liquid fuel stove",
    "96": "Other, specify",
}

LIGHTING = {
    "1": "Electricity",
    "2": "Solar home system",
    "3": "Solar-powered lantern or flashlight",
    "4": "Rechargeable flashlight, mobile, torch or lantern",
    "5": "Battery powered flashlight, torch or lantern",
    "6": "Biogas lamp",
    "7": "LPG lamp",
    "8": "Gasoline lamp",
    "9": "Kerosene or paraffin lamp",
    "10": "Oil lamp",
    "11": "Candle",
    "12": "Open fire",
    "96": "Other, specify",
}

INCOME_CHANGE = {
    "1": "Increased compared to previous year",
    "2": "Been the same compared to previous year",
    "3": "Decreased compared to previous year",
}

GOODS_AFFORDED = {"1": "More", "2": "The same", "3": "Fewer"}

TENURE_RISK = {
    "1": "Very unlikely",
    "2": "Somewhat unlikely",
    "3": "Somewhat likely",
    "4": "Very likely",
    "99": "Don't know",
}

SOCIAL_PROTECTION = {
    "SPF01a": "Cash / in-kind transfers",
    "SPF01b": "School feeding",
    "SPF01c": "Public works",
    "SPF01d": "Subsidies / fee waivers",
    "SPF01e": "Unemployment benefits",
    "SPF01f": "Health insurance",
    "SPF01g": "Old age pension",
    "SPF01h": "Crop / livestock insurance",
    "SPF01j": "Social work (child protection, disability, old persons, GBV)",
    "SPF01k": "Family support",
    "SPF01l": "Psychosocial support",
    "SPF01m": "Vocational training",
    "SPF01n": "Job search services",
    "SPF01o": "Wage subsidies",
    "SPF01p": "Improvements of land tenure security",
}

SOCIAL_PROTECTION_STRATIFIED = {
    "SPF01a": "The Public Service Pension Scheme",
    "SPF01b": "The National Social Security Fund, Workers Compensation",
    "SPF01c": "The Social Assistance Grants for Empowerment (SAGE)",
    "SPF01d": "Public Works Programmes",
    "SPF01e": "Social Care and Support Services",
}

BASIC_FACILITIES = {
    "shelter": "Habitable Shelter",
    "electricity": "Access to Electricity",
    "drinkingwater": "Access to Drinking Water",
    "secure": "Feeling of Security",
    "healthcare": "Access to Healthcare",
}

HOUSING_CONDITIONS = {
    "dwe05_cat": "Not overcrowded",
    "habitablehousing": "Habitable Housing",
    "dwe09_cat": "Affordable",
}

WATER_CONDITIONS = {
    "dwa_cond1": "Reachable under 30 minutes",
    "dwa_cond2": "From an improved source",
    "dwa_cond3": "In the dwelling/yard/plot",
}

TOILET_CONDITIONS = {
    "toi_cond1": "Improved sanitation facility",
    "toi_cond2": "Safe disposal in situ of excreta",
    "toi_cond3": "Toilet is not shared with other households",
}

BANK_ACCESS = {
    "BANK01": "Account in financial institution",
    "BANK02": "Have a ATM/debit card",
    "BANK04": "Used mobile money in the last 12 months",
    "BANK05": "Personally used mobile money in the last 12 months",
}

# Variable labels of the indicators and helper conditions that carry one.
INDICATORS = {
    "electricity": "Access to electricity",
    "healthcare": "Access to healthcare facility",
    "drinkingwater": "Access to drinking water",
    "secure": "Proportion of people residing in physically safe and secure settlements with access to basic facilities",
    "birthCertificate": "Children under 5 with a birth certificate",
    "birthRegistered": "Children under 5 birth registered with civil authorities",
    "impact2_2": "Proportion of people residing in physically safe and secure settlements with access to basic facilities",
    "impact2_3": "Proportion of people with access to health",
    "impact3_3": "Proportion of people that feel safe walking alone in their neighbourhood after dark",
    "outcome1_2": "Proportion of children under 5 years of age whose births have been registered with a civil authority",
    "outcome1_3": "Proportion of people with legally recognized identity documents or credentials",
    "outcome4_1": "Proportion of people who know where to access available GBV service",
    "outcome4_2": "Proportion of people who do not accept violence against women",
    "outcome5_2": "Proportion of children who participate in community-based child protection programmes",
    "outcome8_2": "Proportion of people with primary reliance on clean (cooking) fuels and technology",
    "outcome9_1": "Proportion of people living in habitable and affordable housing",
    "outcome9_2": "Proportion of people that have energy to ensure lighting",
    "outcome10_1": "Proportion of children aged 9 months to five years who have received measles vaccination*",
    "outcome10_2": "Proportion of births attended by skilled health personnel",
    "outcome12_1": "Proportion of people using at least basic drinking water services",
    "outcome12_2": "This indicator measures the proportion of people with access to at least basic sanitation services.",
    "outcome13_1": "Proportion of people with an account at a bank or other financial institution or with a mobile-money-service provider",
    "outcome13_2": "Proportion of people who self-report positive changes in their income compared to previous year",
    "outcome14_1": "Proportion of returnees with legally recognized identity documents or credentials",
    "outcome16_1": "Proportion of people with secure tenure rights to housing and/or land",
    "outcome16_2": "Proportion of people covered by national social protection systems",
}

"""Hashtag categories and the keyword rules of the default classifier."""

from __future__ import annotations

# The legal categories.
CATEGORIES = (
    "Armed Conflict/Wars/Violence",
    "Anti-Semitism/Anti-Zionism",
    "Biodiversity/Animal Conservation",
    "Climate Change/Environmental Issues",
    "Comedy/Humor/Satire",
    "Conferences/Summits/Events",
    "COVID-19/Pandemic/Vaccines",
    "Crime/Police/Law Enforcement/Security",
    "Cryptocurrency/Blockchain/DeFi",
    "Cultural Appropriation/Ethnic Stereotypes/Minority Groups",
    "Culture/Arts/Traditions",
    "Cybersecurity and Cyber Warfare",
    "Democracy/Rule of Law/Constitution",
    "Digitalization/E-Governance/Digital Infrastructure",
    "Economy/Finance/Business",
    "Energy/Renewables/Fossil Fuels",
    "Energy/Climate Change/Renewable Policies",
    "Extremism/Right-Wing/Left-Wing",
    "Food/Vegan/Vegetarian/Diet",
    "Future of Work/Digital Workspaces/Automation",
    "Gender/Diversity/Equality",
    "Geo/Cities/Countries/Locations",
    "Globalization/Trade/Interconnectedness",
    "Health/Healthcare/Medicine",
    "Housing/Rent/Affordable Living",
    "Human Rights/Abuse/Violations",
    "Industry/Manufacturing/Infrastructure",
    "Innovation/Patents/Startups",
    "Government Institutions/Regulations/Bureaucracy",
    "International Relations/Geopolitics/Conflict",
    "Internet/Social Media/Online Communities",
    "Jobs/Careers/Employment",
    "LGBTQ+/LGBTQ+ Rights/Community",
    "TV/Media/Journalism/News Outlets",
    "Mental Health and Wellbeing",
    "Military/Weapons/Arms",
    "Misinformation/Propaganda/Conspiracy Theories/Disinformation",
    "Migration/Refugees/Immigration",
    "Mobility/Transport/Public Infrastructure",
    "Music/Musicians",
    "Nature/Wildlife/Ecology",
    "Other/Uncategorized",
    "Political Parties/Political Systems",
    "Political Theories/Ideologies",
    "Politicians/Elected Officials",
    "Celebrities/Artists/Influencers",
    "Racism/Anti-Racism/Extremism",
    "Religion/Religious Movements/Sects",
    "Renewable Energy/Sustainability",
    "Social Movements/Protests/Activism",
    "Space Exploration/Satellites/Space Policy",
    "Sports/Football",
    "Surveillance/Privacy/Data Protection",
    "Talkshows/News TV/Current Affairs Programs",
    "Technology/AI/Robotics",
    "Transport Revolution/Public Transit/Electric Vehicles",
    "Unemployment/Economic Crisis/Recession",
    "Wokeness/Identity Politics/Cancel Culture",
    "Weather",
)
UNCATEGORIZED = "Other/Uncategorized"
# What a failed or unreadable classification yields.
FALLBACK_CATEGORY, FALLBACK_CONFIDENCE = "Other", 0.0

KEYWORDS = (
    ("klima", "Climate Change/Environmental Issues"),
    ("wetter", "Weather"),
    ("corona", "COVID-19/Pandemic/Vaccines"),
    ("impf", "COVID-19/Pandemic/Vaccines"),
    ("polizei", "Crime/Police/Law Enforcement/Security"),
    ("migra", "Migration/Refugees/Immigration"),
    ("energie", "Energy/Renewables/Fossil Fuels"),
    ("miete", "Housing/Rent/Affordable Living"),
    ("wahl", "Democracy/Rule of Law/Constitution"),
    ("auto", "Mobility/Transport/Public Infrastructure"),
    ("mobil", "Mobility/Transport/Public Infrastructure"),
    ("machinery", "Industry/Manufacturing/Infrastructure"),
    ("mobile", "Technology/AI/Robotics"),
    ("building", "Housing/Rent/Affordable Living"),
    ("household", "Economy/Finance/Business"),
    ("furniture", "Economy/Finance/Business"),
    ("land", "Geo/Cities/Countries/Locations"),
    ("germany", "Geo/Cities/Countries/Locations"),
    ("france", "Geo/Cities/Countries/Locations"),
    ("russia", "Geo/Cities/Countries/Locations"),
    ("russia", "International Relations/Geopolitics/Conflict"),
    ("china", "Geo/Cities/Countries/Locations"),
    ("china", "Globalization/Trade/Interconnectedness"),
    ("united", "International Relations/Geopolitics/Conflict"),
    ("nation", "Geo/Cities/Countries/Locations"),
)

"""Rule values of the catalogue. Operators take them as arguments, so a caller may pass others."""

from __future__ import annotations

# Block lists, taxonomies, titles and templates that results depend on.
TEAM_PATHS = (
    "/team", "/people", "/partners", "/about", "/leadership", "/our-team", "/our-people", "/the-team", "/the-partners",
    "/investment-team", "/meet-the-team", "/about-us", "/who-we-are",
)
SUBPAGES = ("", "/team", "/people", "/partners", "/about", "/leadership", "/portfolio", "/companies", "/contact")
REJECTED_DOMAINS = (
    "crunchbase.com", "linkedin.com", "pitchbook.com", "techcrunch.com", "forbes.com", "bloomberg.com", "reuters.com", "wikipedia.org", "twitter.com", "x.com",
    "youtube.com", "facebook.com", "instagram.com", "medium.com", "substack.com", "angellist.com", "wellfound.com", "dealroom.co", "cbinsights.com", "sifted.eu",
    "venturebeat.com", "seedtable.com", "tracxn.com", "github.com", "gitlab.com", "bitbucket.org", "reddit.com", "news.ycombinator.com", "producthunt.com",
    "glassdoor.com", "indeed.com", "google.com", "apple.com", "amazon.com", "microsoft.com", "notion.site", "wordpress.com", "blogspot.com", "tumblr.com",
    "quora.com", "stackoverflow.com", "dev.to", "hackernoon.com", "businessinsider.com", "cnbc.com", "ft.com", "wsj.com", "nytimes.com", "theverge.com",
    "wired.com", "economist.com", "inc.com", "entrepreneur.com", "fool.com", "seekingalpha.com", "prnewswire.com", "businesswire.com",
)
REJECTED_NAMES = (
    "GitHub", "Forbes", "TechCrunch", "Bloomberg", "Reuters", "LinkedIn", "Crunchbase", "Wikipedia", "Medium", "Substack", "Twitter", "X", "YouTube", "Facebook",
    "Instagram", "AngelList", "Wellfound", "Product Hunt", "Hacker News", "Y Combinator News", "Stack Overflow", "Google", "Apple", "Microsoft", "Amazon",
    "Unknown", "N/A", "Home", "About", "Team", "Portfolio", "Contact", "Blog", "News", "Press",
)
REJECTED_NAME_PARTS = (
    "github", "forbes", "techcrunch", "bloomberg", "reuters", "wikipedia", "linkedin", "crunchbase", "medium.com", "substack", "youtube", "twitter", "facebook",
    "instagram", "newsletter", "subscribe", "all rights reserved", "privacy policy", "terms of service", "cookie policy", "read more", "click here",
    "venture capital firms", "top investors", "best investors", "investor list",
)
REJECTED_PATHS = (
    "/tag/", "/tags/", "/category/", "/author/", "/wp-content/", "/feed", "/rss", "/login", "/signup", "/register", "/cart", "/checkout", "/jobs/", "/careers/",
    "/press-release", "/article/", "/articles/", "/news/", "/blog/", "/stories/",
)
REJECTED_ENDINGS = (".pdf", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".zip", ".xml")
PROFILE_SIGNALS = ("/team", "/people", "/partners", "/portfolio", "/about", "/invest", "/thesis", "/companies", "/our-team", "/leadership")
PUBLISHERS = (
    "github", "forbes", "techcrunch", "bloomberg", "reuters", "medium", "substack", "wikipedia", "linkedin", "crunchbase", "pitchbook", "youtube", "twitter",
    "facebook", "instagram",
)
ARTICLE_PATHS = ("/news/", "/article/", "/blog/", "/stories/", "/posts/", "/tag/")
LEGAL_WORDS = r"\b(ventures?|capital|partners?|vc|llc|l\.l\.c\.|inc|corp|corporation|holdings|advisors|advisory|management|group|fund|investments?)\b"
SOURCE_TYPES = ("investor_profile", "investor_directory", "investor_mention")
ROLE_TITLES = (
    "partner", "managing partner", "general partner", "venture partner", "principal", "investment director", "founding partner", "senior partner",
    "limited partner", "advisor", "associate", "analyst", "team",
)
PREFILTER_WORDS = (
    "invest", "vc", "venture", "capital", "fund", "seed", "equity", "accelerator", "incubator", "angel", "portfolio", "startup", "partner", "founder", "backer",
    "allocator", "syndicate", "financing", "raising", "b2b", "saas", "artificial intelligence", "voice ai", "dealroom", "crunchbase", "pitchbook",
    "y combinator", "techstars",
)
LINK_WORDS = (
    "team", "people", "partner", "about", "leadership", "portfolio", "company", "companies", "contact", "invest", "crew", "associate", "staff", "member", "bio",
    "who-we-are",
)
LINK_FALLBACKS = ("/team", "/about", "/portfolio", "/companies")
LINKS_A_PAGE = 10
SECTOR_NAMES = {
    "saas": "SaaS", "enterprise software": "SaaS", "b2b software": "B2B", "b2b software and services": "B2B", "voice agents": "Voice AI", "speech ai": "Voice AI",
    "conversational ai": "Voice AI", "generative ai": "Artificial Intelligence", "machine learning": "Artificial Intelligence",
    "ai infrastructure": "Artificial Intelligence", "workflow automation": "SaaS", "b2b": "B2B", "ai": "Artificial Intelligence", "b2b saas": "SaaS",
}
STAGE_NAMES = {
    "pre seed": "Pre-Seed", "early-stage": "Seed", "early stage": "Seed", "seed": "Seed", "series a": "Series A", "series b": "Series B",
    "growth equity": "Growth Stage", "growth": "Growth Stage", "buyouts": "Growth Stage", "expansion stage": "Growth Stage",
}
PLACE_NAMES = {
    "usa": "United States", "us": "United States", "united states of america": "United States", "uk": "United Kingdom", "united kingdom": "United Kingdom",
    "great britain": "United Kingdom", "england": "United Kingdom", "middle east and north africa": "Middle East", "mena": "Middle East", "sea": "Southeast Asia",
}
SECOND_STAGE_NAMES = {
    "preseed": "Pre-Seed", "pre-seed": "Pre-Seed", "seed": "Seed", "series a": "Series A", "series b": "Series B", "series c": "Series C",
    "growth": "Growth Stage", "ipo": "IPO Stage",
}
SECOND_SECTOR_NAMES = {
    "ai": ["Artificial Intelligence"], "artificial intelligence": ["Artificial Intelligence"], "enterprise ai": ["Artificial Intelligence"],
    "voice ai": ["Voice AI"], "b2b saas": ["B2B", "SaaS"], "b2b": ["B2B"], "saas": ["SaaS"],
}
SECTORS = ("Artificial Intelligence", "B2B", "SaaS", "Voice AI")
STAGES = ("Pre-Seed", "Seed", "Series A", "Series B", "Growth Stage")
PLACES = ("United States", "India", "Europe", "Southeast Asia", "Middle East", "Global")
THEMES = ("AI infrastructure", "Enterprise Software", "Developer Tools", "Workflow Automation", "Vertical AI", "Voice Agents", "Machine Learning", "Automation")
INVESTOR_TERMS = (
    "venture capital firms", "startup investors", "VC funds", "venture capital", "angel investors", "early-stage investors", "seed investors", "Series A investors",
    "institutional investors", "technology investors",
)
SECTOR_QUERIES = (
    "{s} portfolio companies", "{s} investment thesis", "{s} startup ecosystem investors", "{s} startup funding firms", "{s} startup accelerators",
    "{s} startup investment platforms",
)
PROFILE_TERMS = ("venture capital firms", "startup investors", "VC funds", "early-stage investors")
FALLBACK_QUERIES = ("AI infrastructure venture capital firms", "B2B SaaS seed investors", "early-stage tech startup investors", "venture capital funds list")
THEME_EXPANSIONS = {
    "Artificial Intelligence": ("Generative AI", "Machine Learning", "Foundation Models", "AI Infrastructure", "Enterprise AI", "Autonomous Systems"),
    "Voice AI": ("Conversational AI", "Speech AI", "Speech Infrastructure", "Voice Automation", "AI Communication", "Multimodal AI"),
    "B2B": ("Enterprise Software", "Business Platforms", "Workflow Automation", "Enterprise Infrastructure", "SaaS Infrastructure"),
    "SaaS": ("Cloud Software", "Enterprise SaaS", "Subscription Software", "Vertical SaaS", "Developer Platforms"),
}
MIN_CONFIDENCE = 0.75
MENTION_CONFIDENCE = 0.88

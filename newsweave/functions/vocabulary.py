"""Keyword vocabularies. They are data: pass your own with ``Vocabulary.from_table``."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from newsweave.sources.tables import TOPICS

AI, SECURITY, CLOUD, DEV, EMERGING, BIG_TECH, CULTURE, OPEN_SOURCE = TOPICS

# Words whose presence marks a technology text (plain substrings).
TECH = [
    "technology", "tech", "software", "hardware", "artificial intelligence", "ai", "machine learning", "ml",
    "programming", "coding", "developer", "development", "computer", "computing", "digital", "internet", "web",
    "app", "application", "startup", "silicon valley", "google", "microsoft", "apple", "amazon", "meta",
    "facebook", "twitter", "tesla", "nvidia", "cybersecurity", "security", "blockchain", "cryptocurrency",
    "bitcoin", "cloud", "data science", "analytics", "algorithm", "api", "database", "framework", "open source",
    "github", "linux", "windows", "android", "ios", "mobile", "smartphone", "robotics", "automation", "fintech",
    "edtech", "saas", "platform", "gaming", "virtual reality", "vr", "augmented reality", "ar",
    "quantum computing", "semiconductor", "chip", "processor", "server", "network", "wifi", "bluetooth",
    "electronic", "device", "python", "javascript", "java", "react", "node", "typescript", "rust", "go",
    "kubernetes", "docker", "aws", "azure", "gcp", "devops", "ci/cd", "agile", "scrum", "bug", "feature",
    "release", "version", "update", "upgrade", "patch", "chatbot", "gpt", "llm", "neural", "model", "training",
    "dataset", "inference", "survey", "stackoverflow", "stack overflow", "code", "engineers", "engineering",
]

# The rejection vocabulary, in its order (plain substrings; an entry listed twice counts twice).
REJECT = [
    # adult
    "vibrator", "sex", "adult", "porn", "explicit", "nsfw", "erotic", "sexual", "nude", "naked", "strip", "escort",
    "prostitution", "xxx",
    # promotion and sales
    "lifetime subscription", "lifetime access", "limited time offer", "special deal", "discount", "sale price",
    "reg. price", "half off", "save money", "cheap price", "bargain", "promotion", "promo code", "coupon",
    "deal of the day", "flash sale", "subscription service", "streaming service", "membership deal", "annual plan",
    "get it now", "buy now", "order today", "free trial", "trial offer", "documentary subscription",
    "movie subscription", "tv subscription", "binge-watching", "binge watch", "entertainment subscription", "reg.",
    "save $", "special offer", "subscription plan",
    # entertainment services
    "curiosity stream", "netflix", "hulu", "disney plus", "amazon prime video", "paramount plus", "hbo max",
    "apple tv", "peacock", "discovery plus", "crunchyroll", "funimation", "showtime", "starz", "epix",
    # government, housing and property
    "government policy", "housing policy", "public housing", "income ceiling", "eligibility criteria", "bto",
    "built to order", "hdb", "housing board", "minister", "ministry", "parliament", "senator", "congressman", "mp",
    "minister says", "minister said", "policy review", "policy under review", "eligibility age review",
    "income ceiling review", "public housing policy", "national development minister", "housing supply and demand",
    "national development", "urban planning", "housing scheme", "property prices", "housing supply",
    "housing demand", "affordable housing", "subsidized housing", "residential property", "property market",
    "real estate market", "home ownership", "first-time buyers", "housing grants", "housing loan", "mortgage rates",
    "singles scheme", "flat application", "ballot results", "housing queue",
    # sports
    "sports", "football", "basketball", "baseball", "soccer", "golf", "tennis", "hockey", "rugby", "cricket",
    "swimming", "racing", "olympics", "fifa", "nfl", "nba", "mlb", "athlete", "stadium", "tournament",
    "championship",
    # health
    "medical", "health", "doctor", "hospital", "patient", "disease", "virus", "vaccine", "medicine", "therapy",
    "treatment", "surgery", "clinic", "prescription", "pharmaceutical", "symptoms", "diagnosis", "cancer",
    "diabetes", "heart disease", "mental health", "depression", "anxiety",
    # lifestyle
    "parenting", "autism", "disability", "pregnancy", "baby", "children", "marriage", "wedding", "divorce",
    "relationship", "dating", "romance", "family", "mother", "father", "parent", "kids", "toddler", "infant",
    # food
    "recipe", "cooking", "kitchen", "restaurant", "food", "dining", "chef", "nutrition", "diet", "meal", "calories",
    "ingredients", "baking", "grocery", "supermarket", "fast food", "delivery", "takeout",
    # fashion and beauty
    "fashion", "beauty", "makeup", "skincare", "clothing", "style", "outfit", "jewelry", "accessories", "cosmetics",
    "perfume", "hair", "salon", "designer", "brand", "luxury", "boutique", "shopping",
    # politics
    "politics", "election", "government", "president", "senator", "congress", "parliament", "democracy",
    "republican", "democrat", "vote", "ballot", "campaign", "policy", "legislation", "law", "court", "justice",
    "legal",
    # religion
    "religion", "church", "prayer", "spiritual", "bible", "god", "faith", "christian", "muslim", "jewish",
    "buddhist", "hindu", "mosque", "temple", "worship", "holy", "sacred", "divine", "prophet", "priest", "pastor",
    # travel
    "travel", "vacation", "tourism", "hotel", "flight", "airline", "airport", "destination", "cruise", "resort",
    "trip", "journey", "adventure", "passport", "visa", "booking", "accommodation", "sightseeing",
    # property and personal finance
    "real estate", "property", "mortgage", "insurance", "loan", "debt", "credit card", "bank account", "savings",
    "retirement", "pension", "broker", "realtor", "apartment", "house", "rent", "lease", "investment advice",
    "stock tips", "forex trading", "commodity trading",
    # entertainment
    "celebrity", "entertainment", "movie", "film", "music", "concert", "album", "actor", "actress", "singer",
    "musician", "band", "tv show", "series", "drama", "comedy", "horror", "romance", "documentary", "theater",
    "streaming content", "video content", "television", "cable tv",
    # school
    "school", "teacher", "student", "university", "college", "classroom", "homework", "exam", "grade", "diploma",
    "degree", "tuition", "campus", "dormitory", "scholarship", "academic", "curriculum", "syllabus",
    # weather and environment
    "weather", "rain", "snow", "storm", "hurricane", "tornado", "flood", "drought", "temperature", "climate change",
    "global warming", "pollution", "earthquake", "tsunami", "volcano", "wildfire", "natural disaster",
    "air quality", "outdoor air", "environmental monitoring", "atmosphere", "air pollution", "smog",
    "particulate matter", "pm2.5", "ozone",
    # cars
    "car accident", "traffic jam", "speeding", "parking", "gas station", "oil change", "tire", "engine repair",
    "mechanic", "insurance claim",
    # farming
    "farming", "agriculture", "crop", "harvest", "livestock", "cattle", "chicken", "pig", "farm", "farmer",
    "tractor", "fertilizer", "pesticide",
    # arts and crafts
    "painting", "drawing", "sculpture", "pottery", "knitting", "sewing", "craft", "art gallery", "museum",
    "exhibition", "artist", "canvas",
    # making by hand
    "welding", "aluminum welding", "metalworking", "woodworking", "carpentry", "construction", "building materials",
    "diy project", "handmade", "crafting", "workshop", "tools", "hammer", "drill", "saw", "materials",
    # puzzles
    "wordle", "crossword", "puzzle", "game hints", "game answers", "strands", "connections", "nyt games",
    "word games", "brain games", "sudoku",
    # internet providers
    "internet provider", "internet service", "broadband", "cable", "fiber internet", "isp", "home internet",
    "wifi plan", "internet speed", "internet deals",
    # consumer advice
    "shopping addiction", "fake store", "consumer advice", "buying guide", "product review", "best deals",
    "shopping tips", "retail therapy",
    # news and crime
    "breaking news", "latest news", "current events", "local news", "world news", "crime news", "police report",
    "court case", "lawsuit", "legal battle", "scandal", "controversy", "investigation", "arrest", "charges filed",
    # social issues
    "social issues", "community problems", "social welfare", "poverty", "homelessness", "unemployment",
    "social services", "charity", "donation", "volunteer work", "social activism", "protest", "demonstration",
    # family and social services
    "child abuse", "child welfare", "child protection", "family services", "domestic violence", "elder abuse",
    "social work", "caseworker", "child safety", "family support", "parenting", "childcare", "adoption",
    "foster care", "custody", "guardianship",
    # general news
    "minister said", "government said", "ministry report", "msf report", "ministry of social",
    "social and family development", "high-risk cases", "abuse cases", "incident reports",
    # promotional or spam-like wording
    "tl;dr", "tldr", "elevate your", "get access to", "exclusive access", "limited offer", "act now",
    "dont miss out", "don't miss out", "while supplies last", "hurry up", "last chance", "final days",
    "expires soon", "time sensitive", "urgent", "important notice",
]

# Topic keywords (whole words), in the order the topics are tried.
TOPIC_KEYWORDS = [
    (SECURITY, [
        "security", "cybersecurity", "hack", "hacker", "breach", "vulnerability", "exploit", "cve", "encryption",
        "privacy", "malware", "ransomware", "phishing", "zero-day", "firewall", "antivirus", "vpn",
        "authentication", "password", "biometric", "two-factor", "ssl", "tls", "pentest", "penetration test",
        "red team", "blue team", "infosec", "threat", "mitre", "cisa", "nist", "iso 27001", "cryptography",
        "crypto", "public key", "private key", "certificate", "token", "access control", "siem", "ids", "ips",
        "forensics", "incident response", "bug bounty", "security audit", "rootkit", "keylogger", "spyware",
        "trojan", "worm", "backdoor", "botnet", "cyberattack", "cybercrime", "cyberwarfare", "cyber defense",
        "cyber offense", "zero trust", "mfa", "sso", "xss", "csrf", "sql injection",
    ]),
    (CLOUD, [
        "cloud", "aws", "azure", "gcp", "docker", "kubernetes", "devops", "ci/cd", "deployment", "infrastructure",
        "serverless", "microservices", "containerization", "orchestration", "scalability", "load balancing",
        "terraform", "ansible", "helm", "istio", "cloudflare", "alb", "elb", "s3", "ec2", "lambda", "cloud run",
        "cloud function", "cloud storage", "cloud sql", "cloud native", "service mesh", "argo", "argo cd",
        "prometheus", "grafana", "monitoring", "observability", "opsgenie", "pagerduty",
    ]),
    (OPEN_SOURCE, [
        "open source", "github", "gitlab", "linux", "ubuntu", "debian", "fedora", "arch linux", "red hat",
        "centos", "apache", "mozilla", "gnu", "copyleft", "mit license", "gpl", "bsd license", "apache license",
        "eclipse foundation", "fork", "pull request", "contributor", "maintainer", "foss", "oss", "openstack",
        "kde", "gnome", "freebsd", "openbsd",
    ]),
    (AI, [
        "ai", "artificial intelligence", "machine learning", "ml", "neural network", "deep learning", "nlp",
        "computer vision", "tensorflow", "pytorch", "chatgpt", "llm", "gpt", "bert", "transformer", "openai",
        "anthropic", "claude", "gemini", "copilot", "chatbot", "automation", "robotics", "algorithm", "mistral",
        "llama", "llama 2", "llama 3", "sora", "stable diffusion", "midjourney", "dalle", "dall-e", "slm",
        "small language model", "large language model", "prompt engineering", "vector db", "embedding",
        "inference",
    ]),
    (BIG_TECH, [
        "google", "microsoft", "apple", "amazon", "meta", "facebook", "twitter", "tesla", "nvidia", "intel",
        "amd", "samsung", "startup", "venture capital", "vc", "funding", "investment", "ipo", "acquisition",
        "merger", "spinoff", "spac", "silicon valley", "entrepreneur", "business model", "revenue", "unicorn",
        "series a", "series b", "industry", "market", "stock", "bytedance", "tiktok", "baidu", "alibaba",
        "xiaomi", "huawei", "oracle", "ibm", "sap", "salesforce", "adobe", "paypal",
    ]),
    (DEV, [
        "programming", "coding", "developer", "software", "web development", "javascript", "python", "react",
        "node.js", "framework", "api", "frontend", "backend", "fullstack", "typescript", "angular", "vue", "php",
        "ruby", "java", "c++", "rust", "go", "scala", "kotlin", "mobile", "app", "application", "ios", "android",
        "smartphone", "swift", "objective-c", "flutter", "dart", "svelte", "next.js", "nuxt.js", "express.js",
        "django", "flask", "spring", "dotnet", ".net", "c#", "perl", "matlab", "assembly", "shell script",
    ]),
    (CULTURE, [
        "remote work", "work from home", "developer survey", "salary", "job", "career", "hiring", "interview",
        "workplace", "team", "culture", "burnout", "productivity", "diversity", "inclusion", "tech workers",
        "engineers", "engineering", "stackoverflow", "stack overflow", "survey", "trends", "skills", "layoff",
        "fired", "promotion", "onboarding", "exit interview", "work visa",
    ]),
]


@dataclass(frozen=True)
class Vocabulary:
    tech: tuple[str, ...]
    reject: tuple[str, ...]
    topics: tuple[tuple[str, tuple[str, ...]], ...]
    otherwise: str = EMERGING

    #: A vocabulary is shipped inside the plan, so its size is checked.
    MAX_ENTRIES = 20_000

    @staticmethod
    def default() -> "Vocabulary":
        return Vocabulary(tuple(TECH), tuple(REJECT), tuple((t, tuple(k)) for t, k in TOPIC_KEYWORDS))

    @staticmethod
    def from_table(df: DataFrame, base: "Vocabulary | None" = None) -> "Vocabulary":
        """Read (list, position, keyword) rows; ``list`` is 'tech', 'reject' or a topic label.
        Lists that the table does not hold stay as in ``base`` (the default vocabulary)."""
        base = base or Vocabulary.default()
        rows = df.select("list", "position", "keyword").limit(Vocabulary.MAX_ENTRIES + 1).collect()
        if len(rows) > Vocabulary.MAX_ENTRIES:
            raise ValueError(f"a vocabulary holds at most {Vocabulary.MAX_ENTRIES} entries")
        lists: dict[str, list] = {}
        for row in sorted(rows, key=lambda r: r["position"]):
            lists.setdefault(row["list"], []).append(row["keyword"])
        return replace(base, tech=tuple(lists.get("tech", base.tech)), reject=tuple(lists.get("reject", base.reject)),
                       topics=tuple((t, tuple(lists.get(t, k))) for t, k in base.topics))

"""Word lists, patterns and tables that results depend on. JavaScript's ASCII classes; (?i) ignores case."""

# Titles, in order of the checks.
EXCLUDED_TITLE = r"(?i)(\bintern(ship)?\b|\bgraduate\b|new grad|apprentice|\btrainee\b|working student|werkstudent|\bstudent\b|annotat|label(l)?ing|ai trainer|\btutor\b|\bsales\b|marketing|recruit|account executive|customer success|\bphd\b|research scientist)"
NON_SOFTWARE_TITLE = r"(?i)(designer|manufactur|mechanical|electrical|civil|hardware|firmware|legal|finance|accounting|support engineer|customer engineer|security engineer|quality engineer|test engineer|qa engineer|analytics engineer|network engineer|field engineer|sales engineer|solutions? consultant|technical writer|it engineer|systems administrator)"
ENGINEERING_TITLE = r"(?i)(engineer|engineering|developer|programmer|\bswe\b|software|full[- ]?stack|back[- ]?end|front[- ]?end|architect|\bdevops\b|\bmlops\b|\bsre\b|entwickler|technical staff|\bmts\b|tech lead)"
AI_TITLE = r"(?i)\b(ai|a\.i\.|ki|ml|llms?|genai|nlp|agentic|agents?)\b"
AI_ACRONYM = r"\b(AI|ML|LLMs?|RAG|NLP|GenAI|MLOps)\b"
AI_PHRASE = r"(?i)\b(artificial intelligence|large language models?|generative ai|gen ai|machine learning|deep learning|agentic|ai[- ]agents?|ai[- ]assisted|ai[- ]powered|ai[- ]native|ai[- ]first|retrieval[- ]augmented|prompt engineering|foundation models?|computer vision|copilot|claude code|langchain|llamaindex|vector (?:database|search|store)|openai|anthropic|gpt-?\d?)\b"

# Languages.
ENGLISH_MARKER = r"(?i)(english|englisch|anglais|ingl[eé]s|inglese|engels|engelsk|angielski|ingilizce|ingl[eê]s|الإنجليزية|الانجليزية|영어|英語|英语|английск)"
OTHER_LANGUAGE = r"(?i)\b(german|deutsch|french|fran[cç]ais|arabic|korean|japanese|mandarin|chinese|cantonese|dutch|spanish|italian|portuguese|swedish|danish|norwegian|finnish|polish|turkish|hebrew)\b"
REQUIRED_LANGUAGE = r"(?i)\b(german|deutsch|french|fran[cç]ais|arabic|korean|japanese|mandarin|chinese|dutch|spanish|italian|portuguese|swedish|danish|norwegian|polish|turkish)\b[^.\n]{0,50}\b(required|native|fluent|mandatory|c1|c2|business[- ]level|verhandlungssicher|flie(ß|ss)end)\b"
MERELY_A_PLUS = r"(?i)\b(plus|preferred|nice to have|bonus|advantage|von vorteil|wünschenswert)\b"
NATIONALS_ONLY = r"(?i)saudi nationals? only|saudization role|saudised role"
ENGLISH_STOP_WORDS = "the and to of a in you we with for is our will are on as be this your or an at by from that have".split()

# Scope, sponsorship and levels, in order of the checks.
SCOPES = [
    ("remote_global", r"(?i)remote (worldwide|globally|from anywhere)|work from anywhere|global remote"),
    ("remote_apac", r"(?i)remote (within )?(apac|asia pacific)|apac remote|remote.*indonesia"),
    ("remote_restricted", r"(?i)remote.*(us only|u\.s\. only|eu only|european union only|right to work|reside in)"),
]
SPONSORSHIP = [
    ("yes", r"(?i)visa sponsorship (is )?(available|provided|supported)|we sponsor|sponsorship available|relocation support"),
    ("no", r"(?i)no (visa )?sponsorship|unable to sponsor|not able to sponsor|sponsorship is not"),
]
TITLE_LEVELS = [
    ("lead", r"(?i)\b(staff|principal|distinguished|lead|head|director|manager|vp)\b"),
    ("senior", r"(?i)\b(senior|sr\.?)\b"),
    ("early", r"(?i)\b(junior|jr\.?|associate|entry)\b"),
]
TEXT_LEVELS = [
    ("mid", r"(?i)\b(mid|mid-level|intermediate)\b|\b[3-5]\+ years\b"),
    ("early", r"(?i)\b(junior|early career|1\+ years|2\+ years)\b"),
    ("lead", r"(?i)\b(staff|principal|distinguished)\b"),
    ("lead", r"(?i)\b(lead|head of|manager)\b"),
    ("senior", r"(?i)\bsenior\b|\b[6-8]\+ years\b"),
]
REPLIES = [
    ("bounce", r"(?i)delivery failed|undeliverable|mailbox unavailable|address not found|550 5\.1\."),
    ("auto_reply", r"(?i)out of office|automatic reply|auto-reply|vacation responder"),
    ("negative", r"(?i)unfortunately|not moving forward|decided not to|other candidates|position has been filled|no longer considering"),
]
ROLE_BUCKETS = [
    ("Agentic / AI agents", r"(?i)(agent|agentic)"),
    ("Fullstack", r"(?i)(full[- ]?stack)"),
    ("AI engineer", r"(?i)(?=.*(\bai\b|\bllm|genai|applied ai)).*engineer"),
    ("ML engineer", r"(?i)(machine learning|\bml\b)"),
    ("Backend / platform", r"(?i)(back[- ]?end|platform|infra)"),
    ("Forward deployed", r"(?i)(forward deployed|solutions)"),
    ("Frontend / product", r"(?i)(front[- ]?end|product engineer|web)"),
]

# Places. Country key -> names; then codes.
PLACES = {
    "SG": ["singapore"],
    "AU": ["australia", "sydney", "melbourne", "brisbane", "perth", "adelaide", "canberra"],
    "NZ": ["new zealand", "auckland", "wellington", "christchurch"],
    "US": ["united states", "usa", "u.s.", "new york", "san francisco", "seattle", "austin", "boston", "los angeles", "chicago", "denver", "atlanta", "miami", "washington, dc", "palo alto", "mountain view", "menlo park", "sunnyvale", "san jose", "san diego", "redmond", "bay area", "us only", "us-only"],
    "UK": ["united kingdom", "england", "scotland", "london", "manchester", "edinburgh", "oxford", "bristol", "uk"],
    "CA": ["canada", "toronto", "vancouver", "montreal", "montréal", "ottawa", "calgary", "waterloo", "edmonton"],
    "CH": ["switzerland", "schweiz", "suisse", "zurich", "zürich", "geneva", "genève", "basel", "lausanne", "bern"],
    "DE": ["germany", "deutschland", "berlin", "munich", "münchen", "hamburg", "frankfurt", "cologne", "köln", "stuttgart", "düsseldorf"],
    "AE": ["united arab emirates", "uae", "dubai", "abu dhabi", "sharjah"],
    "QA": ["qatar", "doha"],
    "SA": ["saudi arabia", "ksa", "riyadh", "jeddah", "dammam", "khobar", "neom"],
    "NL": ["netherlands", "amsterdam", "rotterdam", "eindhoven"],
    "IE": ["ireland", "dublin"],
    "FR": ["france", "paris"],
    "ES": ["spain", "madrid", "barcelona"],
    "JP": ["japan", "tokyo"],
    "IN": ["india", "bangalore", "bengaluru", "hyderabad", "pune", "mumbai"],
    "ID": ["indonesia", "jakarta"],
}
US_STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
CANADIAN_PROVINCES = "ON BC QC AB MB SK NS NB NL PE".split()

# Applications by e-mail.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
APPLY_STRONG = r"(?i)\b(send|email|e-mail|mail|submit|forward|share|drop|attach)\b[^.\n]{0,80}\b(cv|c\.v\.|resume|résumé|resumes|application|portfolio|cover letter|github|linkedin profile)\b|\b(apply|applications?|applying|candidates?)\b[^.\n]{0,60}\b(by|via|to|at|through|on)\b[^.\n]{0,30}(e-?mail|@)|\b(bewerbung|lebenslauf|candidature)\b"
APPLY_SOFT = r"(?i)\b(interested|reach out|get in touch|email us|e-mail us|write to us|ping us|contact (me|us))\b"
HIRING_CONTEXT = r"(?i)\b(job|role|position|opening|hiring|join|team|engineer|developer|candidate|apply|application)\b"
HIRING_MAILBOX = r"(?i)^(jobs?|careers?|hiring|recruit(ing|ment|er)?|talent|hr|people|apply|join|work)([._+-].*)?$"
NEVER_MAILBOX = r"(?i)(privacy|gdpr|dpo|legal|abuse|no-?reply|donotreply|security|press|media|invest|billing|invoice|support|help|accommodat|accessib|ethics|compliance|disab|eeo|benefit|payroll|sales|partner|marketing|^info$|feedback|webmaster|admin)"
NEVER_CONTEXT = r"(?i)(accommodation|disabilit|reasonable adjustment|privacy|data protection|personal data|security (issue|vulnerab|report)|report (a|any) (bug|vulnerab)|whistle|equal opportunity|eeo)"
LONG_TLDS = "technology engineering solutions software careers systems digital agency network energy company capital ventures studio health finance global".split()

# Preference model and focus.
PREFERENCE_STOP_WORDS = "the and for with you our are will this that from have your senior staff lead junior engineer engineering software developer team".split()
AGENTIC = r"(?i)\b(agentic|ai[- ]agents?|agents?\b|ai[- ]assisted|copilot|cursor|claude code|codex|llm|large language model|genai|generative ai|rag|tool[- ]use|function calling|prompt)"

# Scheduling.
TIER_HOURS = {1: 1, 2: 3, 3: 24}
CLOSED_CHECK_HOURS = 12
TIER_PRIORITY = {1: 100, 2: 60, 3: 20}

# Pages.
BOT_WALL = ["captcha", "verify you are human", "access denied", "unusual traffic", "cloudflare ray id"]
CLOSED = ["job has been closed", "this position has been filled", "no longer accepting applications"]
ATS_HOSTS = ["greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "workable.com", "teamtailor.com", "recruitee.com", "smartrecruiters.com"]
ID_KEYS = ["gh_jid", "jobId", "job_id", "posting_id", "requisitionId", "requisition_id", "external_id"]

# The evaluator over labelled cases.
CASE_DISQUALIFIERS = [
    ("graduate, new-grad, intern, or apprentice role", r"\b(?:graduate|new grad(?:uate)?|intern(?:ship)?|apprentice)\b", False),
    ("AI training or annotation role", r"\b(?:ai trainer|data annotator|data label(?:ing|ling)|prompt annotator)\b", False),
    ("pure research role", r"\b(?:research scientist|research-only|no production software ownership)\b", False),
    ("non-engineering role", r"\b(?:sales|marketing|recruiter|talent acquisition|business development)\b", True),
]
CASE_AI = r"(?i)\b(?:ai|llm|genai|large language model|generative ai|generative artificial intelligence|applied ai|agentic|agents?|ai[- ]assisted)\b"
CASE_ML = r"(?i)\b(?:machine learning|ml|mlops|models?|inference)\b"
CASE_PRODUCT = r"(?i)\b(?:deploy(?:ed|ing)?|deployment|production|customer[- ]facing|product[- ]facing|inference services?|recommendation|recommender|real[- ]time)\b"
CASE_ENGINEERING = r"(?i)\b(?:engineer|engineering|developer|software|fullstack|full stack|backend|back[- ]end|platform)\b"
CASE_NATIONALS = r"(?i)\b(?:saudi nationals? only|saudization role|saudised role)\b"
CASE_ENGLISH = r"(?i)english|englisch|anglais|inglés|ingles|inglese|engels|engelska|الإنجليزية|الانجليزية|英語|英语|영어"
# name, match; then words of a requirement and of a wish besides the common ones
CASE_LANGUAGES = [
    ("German", "german|deutsch", "verhandlungssicher|voraussetzung", "von vorteil|wünschenswert"),
    ("French", "french|français|francais", "exigé|exige", "souhaité|souhaite"),
    ("Arabic", "arabic|العربية", "مطلوب|إجادة", "يُفضَّل|يفضل"),
    ("Japanese", "japanese|日本語", "必須|ネイティブ", "歓迎"),
    ("Korean", "korean|한국어", "필수|원어민", "우대"),
    ("Mandarin", "mandarin|chinese|普通话|中文", "必须|母语", "优先|加分"),
    ("Dutch", "dutch|nederlands", "vereist|moedertaal", "pre|gewenst"),
    ("Spanish", "spanish|español|espanol", "exigido|nativo", "deseable"),
]
CASE_REQUIRED = "required|requirement|mandatory|must|native|near[- ]native"
CASE_LEVEL = "c1|c2|business level|professional proficiency|fluent|fluency"
CASE_WISH = "plus|preferred|optional|nice to have|advantage"
CASE_FOREIGN = [
    "wir suchen|für|mitarbeiter|erfahrung|voraussetzung|verhandlungssicher|fließend|arbeitsort|m/w/d",
    "nous|recherchons|expérience|vous|avec|ingénieur|exigé|h/f",
    "buscamos|experiencia|para|con|responsable|nativo",
    "ervaring|voor|met|vereist|nederlandse",
    "conoscenza|esperienza|richiediamo|italiaans",
]
CASE_ENGLISH_WORDS = "the|and|or|to|of|in|for|with|on|at|by|from|as|is|are|will|you|your|our|we|be|have|has|can|may|build|work|role|team|experience|production|engineer|developer|remote|language"
CASE_NON_LATIN = r"[\x{0600}-\x{06ff}\x{0e00}-\x{10ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"
SENIORITY_NAMES = {"mid": "mid", "middle": "mid", "intermediate": "mid", "early": "early", "junior": "early", "entry": "early", "senior": "senior", "sr": "senior", "lead": "lead", "staff": "lead", "principal": "lead", "unknown": "unknown"}
CASE_LEVELS = [("lead", r"\b(?:lead|staff|principal|head of|architect)\b"), ("senior", r"\b(?:senior|sr)\b"), ("mid", r"\b(?:mid|intermediate)\b"), ("early", r"\b(?:junior|entry|early)\b")]

# Skills.
SKILLS = [
    ("Python", r"(?i)\bpython\b"), ("TypeScript", r"(?i)\btypescript\b"), ("JavaScript", r"(?i)\bjavascript\b"), ("Go", r"(?i)\bgolang\b|\bgo\b(?= |,|\))"),
    ("Rust", r"(?i)\brust\b"), ("Java", r"(?i)\bjava\b"), ("Kotlin", r"(?i)\bkotlin\b"), ("C++", r"(?i)c\+\+"), ("React", r"(?i)\breact\b"),
    ("Next.js", r"(?i)next\.js"), ("Node.js", r"(?i)node\.?js"), ("Bun", r"(?i)\bbun\b"), ("SQL", r"(?i)\bsql\b"), ("PostgreSQL", r"(?i)postgres"),
    ("Redis", r"(?i)\bredis\b"), ("Kafka", r"(?i)\bkafka\b"), ("Docker", r"(?i)\bdocker\b"), ("Kubernetes", r"(?i)kubernetes|\bk8s\b"),
    ("AWS", r"(?i)\baws\b"), ("GCP", r"(?i)\bgcp\b|google cloud"), ("Azure", r"(?i)\bazure\b"), ("Terraform", r"(?i)terraform"),
    ("LLMs", r"(?i)\bllms?\b|large language model"), ("RAG", r"(?i)\brag\b|retrieval[- ]augmented"), ("AI agents", r"(?i)agentic|ai agents?|\bagents\b"),
    ("Prompt engineering", r"(?i)prompt engineering"), ("Evals", r"(?i)\bevals?\b|evaluation harness"), ("Fine-tuning", r"(?i)fine[- ]tun"),
    ("PyTorch", r"(?i)pytorch"), ("TensorFlow", r"(?i)tensorflow"), ("LangChain", r"(?i)langchain"), ("Vector DBs", r"(?i)vector (database|db|store|search)|pinecone|weaviate|pgvector"),
    ("OpenAI API", r"(?i)openai"), ("Anthropic API", r"(?i)anthropic|claude"), ("MLOps", r"(?i)mlops"), ("GraphQL", r"(?i)graphql"),
    ("REST APIs", r"(?i)\brest(ful)?\b"), ("Microservices", r"(?i)microservice"), ("CI/CD", r"(?i)ci\/cd|continuous (integration|delivery)"),
    ("Distributed systems", r"(?i)distributed systems?"), ("System design", r"(?i)system design"),
]
LISTING_URL = r"(?i)(-jobs-in-|jobs-in-|\/jobs\/?$|\/jobs\?|\/search|\/role\/l\/|\/q-|\/jobs\/[a-z-]+-jobs|\/careers\/?$|\/blog\/|\/employer-blog\/|cv-writing)"

# Lines that name a role, what sites add to titles, free mail services, social sites.
ROLE_LINE = (
    r"(?:hiring|looking for|seeking|join us as|we need|open (?:role|position)s?:?|position:?|role:?)\s+(?:an?\s+|our\s+|(?:a\s+)?(?:new\s+)?)"
    r"((?:senior |junior |lead |staff |principal |founding |mid[- ]level )?[A-Z][A-Za-z/+&.\- ]{1,50}?(?:Engineer|Developer|Architect))"
)
SITE_SUFFIX = r"(?i)\s*[|\-\u2013:]\s*(LinkedIn|Indeed|Glassdoor|Facebook|X|Twitter).*$"
SITE_PREFIX = r"(?i)^.*? on LinkedIn:\s*"
FREE_MAIL = r"(?i)@(gmail|googlemail|yahoo|outlook|hotmail|live|icloud|me|proton|protonmail|aol|gmx|zoho|yandex)\."
SOCIAL_HOST = r"(linkedin|facebook|twitter|x|indeed|reddit)\."
SOCIAL_SITE = r"(?i)linkedin|facebook|indeed|glassdoor"

# Words of young companies.
NEW_COMPANY = r"(?i)\b(start-?up|early[- ]stage|pre-?seed|seed[- ](stage|round|funded)|series a\b|founding (engineer|team|member)|stealth|founded in 20(2[3-6])|(yc|y combinator)\s*\(?[wsfx]2[3-6]|just raised|recently raised|first \d+ (hires|employees)|small team of)\b"

# Zones of countries; hosts that many boards share; parts of the search queries.
COUNTRY_ZONES = {"SG": "Asia/Singapore", "AU": "Australia/Sydney", "NZ": "Pacific/Auckland", "US": "America/New_York", "UK": "Europe/London", "CA": "America/Toronto", "CH": "Europe/Zurich", "DE": "Europe/Berlin", "AE": "Asia/Dubai", "QA": "Asia/Qatar", "SA": "Asia/Riyadh", "ID": "Asia/Jakarta"}
SHARED_HOSTS = ["boards-api.greenhouse.io", "api.lever.co", "api.ashbyhq.com", "api.smartrecruiters.com"]
SEARCH_ROLES = ["AI engineer", "AI software engineer", "LLM engineer", "GenAI engineer", "agentic AI engineer", "AI fullstack engineer", "machine learning engineer"]
SEARCH_PLACES = ["Singapore", "Dubai", "Abu Dhabi", "Riyadh", "Saudi Arabia", "Doha", "Auckland", "Wellington", "Sydney", "Melbourne", "London", "Berlin", "Zurich", "Toronto", "remote"]
SEARCH_PHRASES = ['"send your CV"', '"send your resume"', '"email your CV"', '"apply via email"', '"careers@"', '"hiring@"']
SEARCH_FORMS = ['"{role}" {place} {phrase}', 'site:linkedin.com/posts "{role}" {place} hiring {phrase}', '"{role}" {place} startup hiring {phrase}', '"{role}" {place} ("seed" OR "series A" OR "founding engineer") {phrase}']

# How countries are called, other names of theirs, states, regions, and words that say nothing of a place.
COUNTRY_SHORT = {
    "UK": "UK", "GB": "UK", "US": "US", "AE": "UAE", "SG": "Singapore", "AU": "Australia", "NZ": "New Zealand", "CA": "Canada", "DE": "Germany", "FR": "France", "NL": "Netherlands", "CH": "Switzerland", "IE": "Ireland", "ES": "Spain", "IT": "Italy",
    "SE": "Sweden", "DK": "Denmark", "NO": "Norway", "FI": "Finland", "PL": "Poland", "PT": "Portugal", "AT": "Austria", "BE": "Belgium", "JP": "Japan", "KR": "South Korea", "IN": "India", "ID": "Indonesia", "MY": "Malaysia", "HK": "Hong Kong", "QA": "Qatar",
    "SA": "Saudi Arabia", "IL": "Israel", "BR": "Brazil", "MX": "Mexico", "CZ": "Czechia", "EE": "Estonia", "IS": "Iceland", "LT": "Lithuania",
}
COUNTRY_WORDS = {
    "united kingdom": "UK", "uk": "UK", "great britain": "UK", "england": "UK", "scotland": "UK", "united states": "US", "united states of america": "US", "usa": "US", "us": "US", "america": "US",
    "united arab emirates": "UAE", "uae": "UAE", "deutschland": "Germany", "the netherlands": "Netherlands", "northern america": "",
} | {word.lower(): name for code, name in COUNTRY_SHORT.items() if code not in ("UK", "GB", "US", "AE") for word in (code, name)}
PLACE_STATES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc".split(" ")
    + ["california", "washington", "texas", "massachusetts", "colorado", "illinois", "georgia", "oregon", "virginia", "florida", "new york", "new jersey", "north carolina", "pennsylvania"]
)
PLACE_REGIONS = ["europe", "emea", "apac", "latam", "americas", "north america", "northern america", "asia", "global", "worldwide", "anywhere", "eu"]
PLACE_NOISE = r"(?i)\b(remote(ly)?|hybrid|on-?site|in-?person|office|hq|headquarters|full[- ]?time|part[- ]?time|contract(or)?|permanent|temporary|in the|in|or|and)\b"

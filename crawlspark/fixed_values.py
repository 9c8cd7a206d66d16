"""Fixed values.

Word lists, patterns, limits and lookup tables that have to be exactly these for results to
be right. They are stated here once, as plain data; no logic lives in this file.
"""

# --- language variants -------------------------------------------------------------
# First path segments taken as a language code
LANGUAGE_SEGMENTS = (
    "nl", "fr", "de", "en", "it", "es",
    "nl-be", "fr-be", "de-be", "en-be", "be-nl", "be-fr", "be-de", "be-en",
)
# Query keys that carry a language
LANGUAGE_KEYS = ("lang", "language", "locale", "lng", "lc", "langcode")
# Query keys that only sort, filter or page
PAGINATION_KEYS = (
    "page", "p", "pg", "offset", "limit", "sort", "order", "dir", "orderby",
    "view", "tab", "mode", "layout", "cursor",
)
# Query keys and values that point to a stable resource
IDENTITY_KEY = (
    "(?i)^(chk_.+|.+_id|id|ref|reference|office|branch|venue|store|agency|site|unit|"
    "location|listing|object|property|bureau|kantoor|magasin|filiale|filial|station|"
    "depot|standort|objectid|itemid|propertyid|listingid|agencyid|storeid|officeid|"
    "chkoffice|chk_office|office_id|branch_id|location_id)$"
)
IDENTITY_NUMBER = "^\\p{Nd}{3,}$"
IDENTITY_UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
# Preferred language of a group; anything else, and no language at all, ranks last
LANGUAGE_RANK = {"nl": 0, "en": 1, "fr": 2, "de": 3, "it": 4, "es": 5}
OTHER_LANGUAGE_RANK = 50
QUERY_DIGEST_LENGTH = 40

# --- path scope ---------------------------------------------------------------------
EXCLUDED_SEGMENTS = (
    "artikel", "nieuws", "news", "blog", "jobs", "job", "vacatures", "vacature", "careers",
    "werken-bij", "evenement", "evenementen", "events", "event", "recepten", "recipes",
    "stages", "stage", "internships", "pers", "press", "in-jouw-buurt", "node", "wp-admin",
    "wp-login", "wp-json", "admin", "login", "register", "cart", "checkout", "account",
    "mijn-account", "solliciteer-nu", "spontane-sollicitatie", "contacteer-ons-jobs", "feed",
    "rss", "api", "author", "tag", "category", "categories",
)
ALLOWED_SEGMENTS = (
    "stages", "stage", "internships", "solliciteer-nu", "spontane-sollicitatie",
    "contacteer-ons-jobs",
)

# --- hosts and addresses ------------------------------------------------------------
BLOCKED_HOSTS = (
    "localhost", "127.0.0.1", "0.0.0.0", "::1", "metadata.google.internal", "metadata",
)
BLOCKED_HOST_SUFFIX = ".localhost"
PRIVATE_HOST_PREFIXES = ("127.", "10.", "192.168.")
# Networks that are not public (IANA special-purpose registries), and their public exceptions
CLOSED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32", "224.0.0.0/4",
)
OPEN_V4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6 = (
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
OPEN_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28",
    "2001:30::/28",
)
RESERVED_V6 = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3",
    "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9",
    "ff00::/8",
)

# --- limits -------------------------------------------------------------------------
MAX_LIST_URLS = 5000
MAX_EXPORT_BATCH = 5000
MAX_BODY_BYTES = 2_000_000
FETCH_ATTEMPTS = 8
RETRY_STATUSES = (429, 502, 503, 504)
WAIT_CAP_SECONDS = 120
WAIT_EXTRA_SECONDS = 5
REDIRECT_STATUSES = (301, 302, 303, 307, 308)
MAX_REDIRECTS = 8
FALLBACK_CRAWL_DEPTH = 1
FALLBACK_CRAWL_PAGES = 200
FEW_URLS = 3
DAILY_SITES = 20
STORE_RETRY_SECONDS = 60

# --- documents ----------------------------------------------------------------------
REMOVED_ELEMENTS = ("script", "style", "noscript", "nav", "footer", "header")
SITEMAP_GUESSES = ("/sitemap.xml", "/sitemap_index.xml")
IGNORED_LINK_PREFIXES = ("#", "mailto:", "tel:", "javascript:")
ROBOTS_PATH = "/robots.txt"
DEFAULT_DOCUMENT_NAME = "website"

# --- text ---------------------------------------------------------------------------
# White space at the ends of a text node
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Character references looked up before the whole standard table
FREQUENT_REFERENCES = (
    "amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "trade", "hellip", "mdash",
    "ndash", "lsquo", "rsquo", "ldquo", "rdquo", "laquo", "raquo", "bull", "middot", "euro",
    "pound", "deg", "times", "eacute", "egrave", "agrave", "ccedil", "ecirc", "ocirc", "auml",
    "ouml", "uuml", "szlig", "ntilde", "aacute", "iacute", "oacute", "uacute", "shy",
)

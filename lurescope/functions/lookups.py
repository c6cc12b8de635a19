"""Fixed values that tell indicators from look-alikes; longer lists are parameters."""

from __future__ import annotations

# Mail domains that are no drop boxes.
EMAIL_EXCLUSIONS = (
    "example.com", "example.org", "example.net", "test.com", "localhost", "w3.org", "jquery.com", "google.com", "gmail.com", "schema.org",
    "apache.org", "mozilla.org", "php.net", "github.com", "wordpress.org", "gravatar.com", "fontawesome.com", "microsoft.com", "apple.com", "icloud.com",
    "w3schools.com", "stackoverflow.com", "npmjs.com", "bootstrap.com", "getbootstrap.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com",
    "aol.com", "protonmail.com", "zoho.com", "mysite.com", "abc.com", "domain.com", "yoursite.com", "site.com", "email.com", "yourdomain.com", "company.com", "sampleemail.com",
)
# Local parts of placeholders.
EMAIL_PLACEHOLDERS = (
    "your", "user", "username", "name", "email", "test", "admin", "info", "support", "contact", "hello", "example", "sample", "your.email", "your.name", "youremail", "eg.user",
)
# Words after '@' that are no handles.
HANDLE_EXCLUSIONS = (
    "media", "keyframes", "import", "charset", "supports", "layer", "scope", "container", "property", "apply", "screen", "tailwind", "responsive",
    "click", "start", "input", "change", "focus", "submit", "scroll", "resize", "error", "reset", "select", "toggle", "ended", "abort",
    "param", "return", "throws", "override", "deprecated", "author", "version", "license", "copyright", "since", "licstart", "licend", "gmail", "yahoo", "outlook", "hotmail",
    "context", "graph", "type", "value", "vocab", "reverse", "language", "formatjs", "babel", "types", "angular", "react", "emotion", "popperjs", "floating-ui",
    "iterator", "generator", "asynciterator", "tostringtag", "toprimitive", "tostring", "valueof", "hasinstance",
    "flowcode", "getflowcode", "newrelic", "fontawesome", "roblox", "prezoai", "glimitedaccount", "typedreamhq", "cakeresume", "aboutdotme", "ghost", "dropbox", "miricanvas",
    "lottiefiles", "activecampaign", "lemonde", "lemonde_en", "yahoo_japan_pr", "plesk", "wordpress", "squarespace", "hubspot", "mailchimp", "sendgrid", "intercom", "zendesk",
    "overview", "conference", "widget", "forms", "formsapp", "everyone", "channel", "here", "font-face",
)
# Last labels that a domain may have.
TLDS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "io", "co", "me", "info", "biz", "name", "pro", "mobi", "tel", "asia", "xyz", "online", "site", "store", "app", "dev", "cloud", "tech",
    "live", "shop", "club", "fun", "space", "top", "work", "click", "link", "help", "news", "world", "today", "life", "website", "host", "email", "page", "solutions", "zone", "agency",
    "digital", "media", "center", "network", "us", "uk", "ca", "au", "de", "fr", "it", "es", "nl", "be", "ch", "at", "ru", "cn", "jp", "kr", "in", "br", "mx", "za", "ng", "ke", "eg",
    "pl", "cz", "se", "no", "dk", "fi", "pt", "ie", "nz", "sg", "hk", "tw", "th", "ph", "id", "my", "vn", "pk", "bd", "ar", "cl", "pe", "ve", "ua", "ro", "hu", "bg", "hr", "sk", "si",
    "lt", "lv", "ee", "is", "lu", "gr", "tr", "il", "ae", "sa", "qa", "tk", "ml", "ga", "cf", "gq", "buzz", "rest", "surf", "icu", "cc", "ws", "pw", "to", "ly", "su", "la", "nu",
    "sbs", "cfd", "cyou", "best",
)
# Last labels that properties of scripts have more often than domains.
SCRIPT_TLDS = (
    "name", "id", "is", "at", "br", "ml", "lt", "es", "ee", "no", "me", "to", "au", "in", "my", "qa", "ph", "pt", "ga", "info", "page", "host", "click", "link", "top", "center", "media",
    "th", "jp", "bd", "be",
)
# Names of scripts and markup that look like domains, whole and by their first label.
SCRIPT_NAMES = (
    "navigator.online", "window.location", "document.domain", "window.top", "window.name", "self.name", "parent.top", "screen.info", "history.link", "location.host", "location.site",
    "window.site", "document.link", "element.click", "event.page", "document.page", "window.app", "window.dev", "object.is", "x22object.is", "link.click", "el-descriptions--mini.is",
    "locale-dataset.countries.com", "window.ga", "window.console.info", "window.analytics.page", "window.shopifyanalytics.lib.page", "window.langconfig.id", "window.vk.id",
    "thirdparty.is", "linkel.media", "console.info", "console.log", "console.error", "td.info", "th.info", "tr.info", "tr.in", "td.in", "th.in", "tbody.in", "thead.in", "tfoot.in",
    "loc.host", "custom.host",
)
SCRIPT_OBJECTS = (
    "this", "self", "window", "document", "navigator", "element", "event", "error", "screen", "history", "location", "parent", "caller", "button", "input", "form", "link", "file",
    "cookie", "entry", "source", "asset", "media", "place", "attr", "attribute", "item", "data", "browser", "object", "tbody", "thead", "tfoot", "field",
)
# Labels of message keys (in names of four labels or more) and of states of markup (three or more).
MESSAGE_LABELS = ("error", "message", "input", "required", "format")
STATE_LABELS = (
    "collapse", "toggle", "show", "hide", "fade", "active", "disabled", "visible", "invisible", "open", "closed", "expanded", "collapsed", "selected", "checked", "country-selector-dropdown",
)
# Words of a line that make its domains surer.
HOST_WORDS = ("host", "server", "smtp", "url", "send", "post", "gate")
# What a URL or its line holds where loot is sent; case counts, though both are lower-cased first.
LOOT_WORDS = (
    "exfil", "steal", "grab", "gate", "next.php", "post.php", "done.php", "finish.php", "send.php", "save.php", "log.php", "gate.php", "panel.php", "result.php", "collect.php",
    "bot_token", "chat_id", "sendMessage", "telegram.org/bot",
)
# Ends of paths that are files of a page.
PAGE_FILES = (
    ".css", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".map", ".min.js", ".min.css", ".js", ".mp3", ".mp4", ".webm", ".ogg", ".pdf",
)
# Hosts that no public name is under, and sign-in hosts that proxies show.
INNER_ENDS = (".transaction", ".internal", ".local", ".invalid", ".test")
SIGN_IN_HOSTS = (
    "login.microsoftonline.com", "login.microsoft.com", "accounts.google.com", "login.live.com", "login.windows.net", "sts.windows.net", "aadcdn.msauth.net", "aadcdn.msftauth.net",
)

#: Roots of common services, a default for the parameter of that name: a deployment gives its own list.
SERVICES = (
    "google.com", "googleapis.com", "gstatic.com", "googletagmanager.com", "google-analytics.com", "youtube.com", "microsoft.com", "microsoftonline.com", "office.com", "live.com",
    "windows.net", "msauth.net", "msftauth.net", "apple.com", "icloud.com", "amazon.com", "facebook.com", "facebook.net", "instagram.com", "twitter.com", "linkedin.com", "github.com",
    "cloudflare.com", "cloudfront.net", "jsdelivr.net", "unpkg.com", "jquery.com", "bootstrapcdn.com", "fontawesome.com", "w3.org", "schema.org", "mozilla.org", "wikipedia.org",
    "wordpress.org", "wordpress.com", "jotform.com", "typeform.com", "paypal.com", "stripe.com", "dropbox.com", "adobe.com", "yahoo.com",
)

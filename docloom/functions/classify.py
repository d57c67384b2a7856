"""Ordered rules for categories, sensitivity, change types and levels, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import filename_words, suffix

# Categories and the rules that give them, in their order.
CATEGORIES = (
    "Documents/Invoices", "Documents/Receipts", "Documents/Contracts", "Documents/Resumes", "Documents/Reports", "Documents/General",
    "Media/Images", "Media/Screenshots", "Media/Videos", "Media/Audio", "Archives", "Code", "Installers", "Other",
)
NAME_RULES = (
    ("screenshot|screen[-_ ]?shot|snip", "Media/Screenshots"),
    ("invoice|bill|receipt", "Documents/Invoices"),
    ("contract|agreement|nda", "Documents/Contracts"),
    ("resume|cv|curriculum[-_ ]?vitae", "Documents/Resumes"),
    ("report|summary|annual", "Documents/Reports"),
    ("install|setup|installer|msi|pkg", "Installers"),
)
EXTENSIONS = {
    ".pdf": "Documents/General",
    ".doc": "Documents/General",
    ".docx": "Documents/General",
    ".rtf": "Documents/General",
    ".odt": "Documents/General",
    ".txt": "Documents/General",
    ".md": "Documents/General",
    ".csv": "Documents/Reports",
    ".xls": "Documents/Reports",
    ".xlsx": "Documents/Reports",
    ".ppt": "Documents/Reports",
    ".pptx": "Documents/Reports",
    ".png": "Media/Images",
    ".jpg": "Media/Images",
    ".jpeg": "Media/Images",
    ".gif": "Media/Images",
    ".webp": "Media/Images",
    ".bmp": "Media/Images",
    ".tif": "Media/Images",
    ".tiff": "Media/Images",
    ".mp4": "Media/Videos",
    ".mov": "Media/Videos",
    ".mkv": "Media/Videos",
    ".avi": "Media/Videos",
    ".mp3": "Media/Audio",
    ".wav": "Media/Audio",
    ".flac": "Media/Audio",
    ".zip": "Archives",
    ".rar": "Archives",
    ".7z": "Archives",
    ".tar": "Archives",
    ".gz": "Archives",
    ".bz2": "Archives",
    ".xz": "Archives",
    ".exe": "Installers",
    ".msi": "Installers",
    ".appx": "Installers",
    ".msix": "Installers",
    ".ps1": "Code",
    ".py": "Code",
    ".js": "Code",
    ".ts": "Code",
    ".jsx": "Code",
    ".tsx": "Code",
    ".json": "Code",
    ".yaml": "Code",
    ".yml": "Code",
    ".html": "Code",
    ".css": "Code",
    ".cs": "Code",
    ".java": "Code",
    ".go": "Code",
    ".rs": "Code",
    ".c": "Code",
    ".cpp": "Code",
    ".h": "Code",
    ".sh": "Code",
}
MIME_RULES = (
    ("image/", "Media/Images"), ("video/", "Media/Videos"), ("audio/", "Media/Audio"), ("application/zip", "Archives"),
    ("application/x-7z-compressed", "Archives"), ("application/x-rar-compressed", "Archives"), ("application/x-msdownload", "Installers"),
    ("application/vnd.microsoft.portable-executable", "Installers"),
)
GENERAL_MIMES = ("text/plain", "text/markdown", "application/json", "text/csv")
CONTENT_RULES = (
    (r"\binvoice\b|\bbalance due\b|\bamount due\b|\bvat\b", "Documents/Invoices"),
    (r"\breceipt\b|\bsubtotal\b|\btax\b|\bmerchant\b", "Documents/Receipts"),
    (r"\bcontract\b|\bagreement\b|\bparty\b|\bterms\b", "Documents/Contracts"),
    (r"\bresume\b|\bcurriculum vitae\b|\bexperience\b|\beducation\b", "Documents/Resumes"),
    (r"\breport\b|\bsummary\b|\banalysis\b|\bfindings\b", "Documents/Reports"),
    (r"\bscreenshot\b|\bui\b|\berror\b|\bcapture\b", "Media/Screenshots"),
)
# What decides when no other rule does.
LATE_WORDS = (("invoice|amount due|bill to", "Documents/Invoices"), ("resume|curriculum vitae|work experience", "Documents/Resumes"))
SNIPPET = 1500

# What counts as sensitive.
SENSITIVE_WORDS = ("password", "confidential", "secret", "api_key", "token", "auth", "private", "salary", "credentials")
SENSITIVE_PATTERNS = (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", r"\b[\w\.-]+@[\w\.-]+\.\w+\b", r"\b\d{3}-\d{2}-\d{4}\b")

# Kinds of a changed line, in their order.
CHANGE_TYPES = (
    ("function", r"\bdef\b|\bfunction\b"), ("class", r"\bclass\b"), ("variable", r"\b\w+\s*="), ("loop", r"\bfor\b|\bwhile\b"),
    ("conditional", r"\bif\b|\belse\b|\belif\b"), ("return", r"\breturn\b"), ("import", r"\bimport\b|\bfrom\b"),
)

# Which files are indexed.
SUPPORTED = ("pdf", "docx", "txt", "pptx", "csv", "xlsx", "xls", "png", "jpg", "jpeg")
IMAGES = ("png", "jpg", "jpeg")
SKIPPED = ("log", "tmp", "bak", "old", "cache", "dmp", "swp", "swo", "part", "crdownload", "download", "lnk", "url")
SKIPPED_NAMES = ("thumbs.db", "desktop.ini", ".ds_store")
IGNORED_DIRS = (
    "windows", "program files", "program files (x86)", "programdata", "$recycle.bin", "system volume information", "recovery", "msocache",
    "intel", "perflogs", "boot", "appdata", ".cache", ".local", ".config", "google",
    "mozilla", "edge", "chrome", "firefox", "node_modules", ".git", ".venv", "venv",
    "__pycache__", "build", "dist", "out", "target", "bin", "obj", ".vs",
    ".idea", ".vscode", ".antigravity", "packages", "site-packages", "npm", "pip", "conda",
    ".nuget", ".cargo", ".rustup", ".gradle", ".m2", ".npm", ".yarn", "steam",
    "steamapps", "origin", "epicgames", "epic games", "steam library", "nvidia", "amd", "logs",
    "temp", "tmp", "game", "games", "gamecache", "game cache", "shadercache", "cache",
    "caches", "code", "codes", "flutter", "android", "sdk", "system", "system32",
)
# Names of files that come and go.
TRANSIENT = (
    r"\.crdownload$", r"\.tmp$", r"\.partial$", r"^~\$", r"^~.*", r"^desktop\.ini$", r"^thumbs\.db$", r"^\._", r"\.ds_store$",
    r"\.download$", r"\.aria2$", r":Zone\.Identifier$", r"\.lnk$",
)
TEMP_SUFFIXES = (".tmp", ".part", ".crdownload", ".download")
# Paths that are never written.
PROTECTED = (
    r"^[A-Z]:\\Windows", r"^[A-Z]:\\Program Files", r"^[A-Z]:\\Program Files \(x86\)", r"^[A-Z]:\\ProgramData",
    r"^[A-Z]:\\System Volume Information", r"^[A-Z]:\\Recovery", r"^[A-Z]:\\Config\.Msi",
)
# What a listing leaves out, and the dot files it shows.
HIDDEN_FILES = (
    "config.msi", "dumpstack.log", "dumpstack.log.tmp", "hiberfil.sys", "pagefile.sys", "swapfile.sys",
    "bootmgr", "bootsect.bak", "boot.ini", "ntldr", "ntdetect.com", "io.sys",
    "msdos.sys", "autoexec.bat", "config.sys", "desktop.ini", "thumbs.db",
)
HIDDEN_FOLDERS = ("recovery", "system volume information", "$recycle.bin", "perflogs", "$windows.~bt", "$windows.~ws")
HIDDEN_EXTENSIONS = (".dll", ".sys", ".ini", ".tmp", ".log", ".bak", ".old", ".cache", ".dat", ".db", ".ldf", ".mdf")
SHOWN_DOTFILES = (".env", ".gitignore", ".antigravityignore", ".editorconfig")
KIB = 1024


def first_match(value: Column, rules, flags: str = "(?i)") -> Column:
    """The label of the first rule (pattern, label) found in the value; null for none."""
    hits = [F.when(value.rlike(flags + pattern), F.lit(label)) for pattern, label in rules]
    return F.coalesce(*hits)


def by_filename(path: Column) -> Column:
    return first_match(filename_words(path), NAME_RULES)


def by_extension(path: Column) -> Column:
    pairs = [F.lit(x) for pair in EXTENSIONS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), suffix(path))


def by_mime(mime: Column) -> Column:
    hits = [F.when(mime.startswith(prefix), F.lit(label)) for prefix, label in MIME_RULES]
    return F.coalesce(*hits, F.when(mime.isin(*GENERAL_MIMES), F.lit("Documents/General")))


def by_content(text: Column) -> Column:
    snippet = F.substring(text, 1, SNIPPET)
    return F.coalesce(first_match(snippet, CONTENT_RULES), first_match(F.lower(snippet), LATE_WORDS, ""))


def category(path: Column, mime: Column | None, text: Column, model: Column | None = None) -> Column:
    """Name, extension, MIME type, content, then the answer of a model if one is plugged in; else Other."""
    steps = [by_filename(path), by_extension(path), *([by_mime(mime)] if mime is not None else []), by_content(text)]
    return F.coalesce(*steps, *([clean_label(model)] if model is not None else []), F.lit("Other"))


def clean_label(answer: Column) -> Column:
    """A known category from a model's free answer: equal, or else the first one contained."""
    low = F.lower(F.regexp_replace(F.trim(answer), "^[\"'`]+|[\"'`]+$", ""))
    equal = [F.when(low == c.lower(), F.lit(c)) for c in CATEGORIES]
    inside = [F.when(low.contains(c.lower()), F.lit(c)) for c in CATEGORIES]
    return F.coalesce(*equal, *inside)


def sensitive(line: Column) -> Column:
    word = F.lower(line).rlike("|".join(SENSITIVE_WORDS))
    return reduce(lambda a, p: a | line.rlike(p), SENSITIVE_PATTERNS, word)


def change_type(text: Column) -> Column:
    return F.coalesce(first_match(text, [(p, t) for t, p in CHANGE_TYPES], ""), F.lit("generic"))


def change_sentence(op: Column, text: Column) -> Column:
    head = F.substring(text, 1, 100)
    verb = F.when(op == "insert", "Added").when(op == "delete", "Removed").when(op == "modify", "Modified")
    plain = F.trim(head)
    return F.when(verb.isNull(), F.concat(F.lit("Changed: "), plain)).otherwise(F.concat(verb, F.lit(" "), change_type(head), F.lit(": "), plain))


def supported_file(name: Column) -> Column:
    low = F.lower(name)
    bad = low.isin(*SKIPPED_NAMES) | low.startswith(".") | low.startswith("~$") | low.endswith("~") | low.rlike(rf"\.({'|'.join(SKIPPED)})$")
    return F.coalesce(~bad & low.rlike(rf"\.({'|'.join(SUPPORTED)})$"), F.lit(False))


def ignored_dir(path: Column) -> Column:
    """Whether any folder of the path is hidden or ignored (the last part is the file's name)."""
    parts = F.split(F.lower(path), r"[\\/]")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return F.exists(folders, lambda p: p.startswith(".") | p.isin(*IGNORED_DIRS))


def valid_size(name: Column, size: Column) -> Column:
    image = F.lower(name).rlike(rf"\.({'|'.join(IMAGES)})$")
    return (size <= 50 * KIB * KIB) & (~image | size.between(50 * KIB, 15 * KIB * KIB))


def version_format(name: Column) -> Column:
    ext = suffix(name)
    return F.when(ext.isin(".docx", ".docm"), "word").when(ext.isin(".xlsx", ".xlsm", ".xls"), "excel").otherwise("text")


def diff_summary(diff: Column) -> Column:
    """What a unified diff amounts to, from its added and removed lines."""
    added, removed = (F.regexp_count(diff, F.lit(p)) for p in ("\n\\+", "\n-"))
    return (
        F.when(added > removed * 2, "Major feature additions detected.")
        .when(removed > added * 2, "Significant content removal detected.")
        .when((added > 0) | (removed > 0), "Minor modifications made.")
        .otherwise("No significant changes.")
    )


def diff_intent(diff: Column) -> Column:
    return (
        F.when(diff.contains("def ") | diff.contains("class "), "Feature Update")
        .when(diff.contains("try:") | diff.contains("except"), "Bug Fix")
        .when(diff.contains("import "), "Dependency Change")
        .when(F.regexp_count(diff, F.lit("\n-")) > 20, "Deletion Heavy")
        .otherwise("Refactor")
    )


def transient(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(TRANSIENT))


def temporary(path: Column) -> Column:
    low = F.lower(path)
    return reduce(lambda a, e: a | low.endswith(e), TEMP_SUFFIXES, F.lit(False))


def protected(path: Column) -> Column:
    return path.rlike("(?i)" + "|".join(PROTECTED))


def hidden(name: Column) -> Column:
    """Files and folders that a listing leaves out."""
    low = F.lower(name)
    out = low.isin(*HIDDEN_FILES, *HIDDEN_FOLDERS) | suffix(low).isin(*HIDDEN_EXTENSIONS) | name.startswith(".")
    return ~low.isin(*SHOWN_DOTFILES) & out

"""Fixed values of the data model."""

from __future__ import annotations

# fixed values: terms that never count as keywords
STOPWORDS = (
    "the and or but if then else of at by for with about is am are was were be been being have has had do does did can could "
    "will would shall should may might must this that these those a an as in on to from into through i you he she it we they my "
    "your his her its our their what which who whom whose where why how "
    "0 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 30 40 50 100 1000"
).split()

# fixed values: the tag of an extension, written without its dot
EXTENSION_TAGS = {
    "document": "pdf docx doc rtf odt",
    "spreadsheet": "xlsx",
    "presentation": "pptx",
    "text": "txt log",
    "markdown": "md",
    "image": "jpg jpeg png gif svg bmp webp tiff",
    "audio": "mp3 wav flac ogg aac m4a wma",
    "video": "mp4 avi mkv mov wmv flv webm",
    "archive": "zip tar gz rar 7z",
    "data": "json xml csv yaml yml toml sql",
    "config": "ini cfg conf env",
    "code": "py js ts go rs java c cpp h hpp rb php sh bat ps1",
    "web": "html htm css scss",
}

# fixed values: MIME types by extension, and the type of all others
MIME_TYPES = {
    "application/pdf": ".pdf",
    "text/plain": ".txt .md .log",
    "text/html": ".html .htm",
    "application/json": ".json",
    "application/xml": ".xml",
    "text/csv": ".csv",
    "image/png": ".png",
    "image/jpeg": ".jpg .jpeg",
    "image/gif": ".gif",
    "image/svg+xml": ".svg",
    "image/webp": ".webp",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.ms-powerpoint": ".ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "application/zip": ".zip",
    "application/x-tar": ".tar",
    "application/gzip": ".gz",
    "audio/mpeg": ".mp3",
    "video/mp4": ".mp4",
    "application/x-msdownload": ".exe",
}
OTHER_MIME = "application/octet-stream"

# fixed values: extensions whose text can be extracted
TEXT_EXTENSIONS = (
    ".txt .md .log .csv .json .xml .yaml .yml .toml .ini .cfg .conf .sh .bat .ps1 .py .js .ts .go .rs .java .c .cpp .h .hpp .rb .php .sql "
    ".env .gitignore .html .htm .svg .css .scss"
).split()
SUPPORTED_EXTENSIONS = [*TEXT_EXTENSIONS, ".pdf", ".docx", ".xlsx", ".pptx"]

MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_TEXT_BYTES = 500 * 1024
LIST_LIMIT = 10_000
TOP_TERMS, TOP_PROFILE, TAG_SCORE = 100, 20, 5.0
MIN_SIMILARITY, SUB_STEP, MIN_FILES, MAX_FILES = 0.45, 0.15, 3, 50
COHERENT = 0.15
GUARD_DEPTH = 3
SORT_COLUMNS = ("name", "extension", "size", "modified_at", "indexed_at", "processing_status")

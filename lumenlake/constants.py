"""Fixed values.

Everything here has to be exactly as given for results to be right: extension
lists, folder names, size limits, message texts.  The two pairs of extension
lists differ on purpose (the scan accepts raw formats and 3gp, the type test
does not), so they must not be merged.
"""

# Extensions accepted when scanning folders.
SCAN_IMAGE = [
    "jpg", "jpeg", "png", "gif", "bmp", "webp", "heic", "heif", "tiff", "tif",
    "raw", "cr2", "nef", "arw", "dng",
]
SCAN_VIDEO = ["mp4", "mov", "avi", "mkv", "wmv", "flv", "webm", "m4v", "3gp"]

# Extensions that count as image or video in a catalogue.
TYPE_IMAGE = ["jpg", "jpeg", "png", "gif", "bmp", "webp", "heic", "heif", "tiff", "tif"]
TYPE_VIDEO = ["mp4", "mov", "avi", "mkv", "wmv", "flv", "webm", "m4v"]

# Size gates, both strict upper bounds in bytes.
HASH_LIMIT = 50 * 1024 * 1024
META_LIMIT = 10 * 1024 * 1024

# Fixed value: bits out of 64 that two perceptual hashes may differ in.
SIMILARITY_THRESHOLD = 10

# Names of the three kinds of duplicate group.
EXACT = "exact"
SIMILAR = "similar"
NAME_MATCH = "nameMatch"

# Folder names used by the layout strategies.
FOLDER_IMAGES = "Images"
FOLDER_VIDEOS = "Videos"
FOLDER_OTHER = "Other"
FOLDER_NO_CAMERA = "Unknown"
LOCATION_FOLDERS = {"country": "ByCountry", "city": "ByCity", "exact": "ByGPS"}

# The date folder formats.
DATE_FORMATS = ["yearMonthDay", "yearMonth", "yearOnly", "flatDate"]

# The four ready-made strategies, in menu order.
PRESETS = {
    "By Date (Year/Month/Day)": {"type": "byDate", "format": "yearMonthDay"},
    "By Date (Year/Month)": {"type": "byDate", "format": "yearMonth"},
    "By Camera": {"type": "byCamera"},
    "By File Type": {"type": "byType"},
}

# Characters not allowed in a folder name, each becoming "_".
FOLDER_FORBIDDEN = '/\\:*?"<>|'

# Metadata tags that feed the catalogue.
TAG_DATE = "DateTimeOriginal"
TAG_WIDTH = "PixelXDimension"
TAG_HEIGHT = "PixelYDimension"
TAG_MODEL = "Model"
TAGS = [TAG_DATE, TAG_WIDTH, TAG_HEIGHT, TAG_MODEL]

# Size units, each 1024 times the one before.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]

# Progress phases.
PHASES = [
    "Initializing", "Scanning", "Hashing", "MetadataExtraction", "Deduplication",
    "Organizing", "Complete", "Cancelled", "Error",
]

# Fixed value: a progress record is emitted for every tenth file and the last.
PROGRESS_EVERY = 10

# List lengths of the short reports.
PREVIEW_HASHES = 3
PREVIEW_FILES = 10
PREVIEW_FOLDERS = 10
PREVIEW_CONFLICTS = 5
PREVIEW_PER_FOLDER = 3

"""Fixed values the results depend on.

FIXED VALUES (must stay exactly as listed; they define class order,
feature order and the user-facing defaults and messages):

- class labels, in model output order (class index = position):
  Cardiomegaly, Emphysema, Effusion, Hernia, Infiltration, Mass, Nodule,
  Atelectasis, Pneumothorax, Pleural_Thickening, Pneumonia, Fibrosis,
  Edema, Consolidation
- serving feature columns, in model input order:
  age_norm, sex_bin, view_AP, view_PA
- default features for images without metadata: 0.5, 0.0, 0.0, 1.0
- upload defaults: age 50, gender M, view PA
- accepted upload file extensions: png, jpg, jpeg
- top-k for heatmaps 3, top list on result pages 5
- validation age range 0..150, serving clip 0..100
- percent bands: >= 50 high, >= 25 medium, else low
- folder key pattern: letters then 8 digits; fallback date text Unknown,
  fallback raw date 00000000; empty sanitized name -> Unknown
- record sources: web_upload, spark_batch, batch_sequential
- validation and form messages: see the MSG_* constants below
- pixel scaling "imagenet" (per-channel RGB, after x / 255):
  mean 0.485, 0.456, 0.406; std 0.229, 0.224, 0.225
- registry file names: original.png, heatmap files gradcam_<label>.png
  (blanks and slashes in the label become underscores), metadata.json,
  predictions.json; result message "Saved to <registry root>/<folder>"
"""

LABELS = [
    "Cardiomegaly", "Emphysema", "Effusion", "Hernia", "Infiltration",
    "Mass", "Nodule", "Atelectasis", "Pneumothorax", "Pleural_Thickening",
    "Pneumonia", "Fibrosis", "Edema", "Consolidation",
]

META_COLS = ["age_norm", "sex_bin", "view_AP", "view_PA"]

DEFAULT_FEATURES = {"age_norm": 0.5, "sex_bin": 0.0, "view_AP": 0.0, "view_PA": 1.0}

UPLOAD_DEFAULTS = {"age": 50, "gender": "M", "view": "PA"}

ALLOWED_EXTENSIONS = ["png", "jpg", "jpeg"]

TOP_K_HEATMAPS = 3
TOP_K_DISPLAY = 5
BATCH_SIZE = 32

AGE_VALID_MIN, AGE_VALID_MAX = 0, 150
AGE_CLIP_MIN, AGE_CLIP_MAX = 0, 100

BAND_HIGH, BAND_MEDIUM = 50.0, 25.0

FOLDER_PATTERN = r"^([A-Za-z]+)(\d{8})$"
UNKNOWN_NAME = "Unknown"
UNKNOWN_DATE = "Unknown"
UNKNOWN_DATE_RAW = "00000000"
NO_LABEL = "No Label"

SOURCES = ["web_upload", "spark_batch", "batch_sequential"]

ORIGINAL_IMAGE = "original.png"
HEATMAP_PREFIX = "gradcam_"
IMAGE_SUFFIX = ".png"
METADATA_DOC = "metadata.json"
PREDICTIONS_DOC = "predictions.json"
MSG_SAVED = "Saved to {}/{}"

# Validation messages (fixed text; {} is the offending value).
MSG_AGE = "Invalid age: {}. Must be between 0 and 150."
MSG_GENDER = "Invalid gender: {}. Must be 'M' or 'F'."
MSG_VIEW = "Invalid view: {}. Must be 'AP' or 'PA'."
MSG_FORMAT = "Invalid image format: {}. Must be PNG or JPEG."
MSG_UNREADABLE = "Could not read image: {}"
MSG_NO_SCORES = "The model returned no usable scores"
# Upload form checks (first failing one is reported).
MSG_FILE_TYPE = "Invalid file type. Please upload PNG or JPEG."
MSG_NAME_REQUIRED = "Patient name is required"
MSG_AGE_VALUE = "Invalid age value"

IMAGENET_MEAN = [0.485, 0.456, 0.406]
IMAGENET_STD = [0.229, 0.224, 0.225]

# File signatures used to recognise image formats without decoding.
PNG_MAGIC_HEX = "89504E470D0A1A0A"
JPEG_MAGIC_HEX = "FFD8FF"
SIGNATURES = [("PNG", PNG_MAGIC_HEX), ("JPEG", JPEG_MAGIC_HEX), ("GIF", "47494638"), ("BMP", "424D"), ("TIFF", "49492A00"),
              ("TIFF", "4D4D002A")]

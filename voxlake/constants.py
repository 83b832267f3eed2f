"""Results depend on them, so they are stated as they are."""

# Workflow phases in order, with who acts in them.
PHASES = [
    ("init", "interaction"),
    ("identifying", "computation"),
    ("awaiting_speaker_validation", "interaction"),
    ("transcribing", "computation"),
    ("awaiting_transcription_review", "interaction"),
    ("translating", "computation"),
    ("awaiting_translation_review", "interaction"),
    ("synthesizing", "computation"),
    ("awaiting_audio_validation", "interaction"),
    ("recomposing", "computation"),
    ("complete", "interaction"),
]

# The short chain used for plain transcripts.
TRANSCRIPT_PHASES = [
    "init",
    "identifying",
    "awaiting_speaker_validation",
    "transcribing",
    "awaiting_transcription_review",
    "complete",
]
SPEAKER_PHASES = ["identifying", "awaiting_speaker_validation"]

# Phases a project may be restarted from.
RESTART_PHASES = ["init", "identifying", "transcribing", "translating", "synthesizing", "recomposing"]

# Progress range of each computing phase, as (phase, start percent, width).
PHASE_SPANS = [
    ("identifying", 20, 40),
    ("transcribing", 35, 25),
    ("translating", 45, 15),
    ("synthesizing", 65, 20),
    ("recomposing", 88, 4),
]

# The ranges of the one-pass dubbing, and of the translation before a review.
ONE_PASS_SPANS = [("translating", 40, 20), ("synthesizing", 65, 15)]
REVIEW_SPANS = [("translating", 20, 50)]

# Status shown to people.
STATUS_LABELS = {
    "awaiting_input": "Needs Input",
    "awaiting_validation": "Review",
    "completed": "Done",
    "processing": "Running",
    "queued": "Queued",
    "failed": "Failed",
    "error": "Error",
    "cancelled": "Cancelled",
    "paused": "Paused",
    "resuming": "Resuming...",
}

# Colour class of a status.
STATUS_CLASSES = {
    "completed": "success",
    "processing": "processing",
    "queued": "pending",
    "awaiting_validation": "attention",
    "awaiting_input": "attention",
    "failed": "error",
    "error": "error",
    "paused": "attention",
    "cancelled": "error",
    "resuming": "processing",
}

# Language code, display name, other spellings of the same language.
LANGUAGES = [
    ("en", "English", ["english", "eng"]),
    ("es", "Spanish", ["spanish", "spa"]),
    ("fr", "French", ["french", "fra"]),
    ("de", "German", ["german", "deu"]),
    ("it", "Italian", ["italian", "ita"]),
    ("pt", "Portuguese", ["portuguese", "por"]),
    ("zh", "Chinese", ["chinese", "chi", "zho"]),
    ("ja", "Japanese", ["japanese", "jpn"]),
    ("ko", "Korean", ["korean", "kor"]),
    ("ar", "Arabic", ["arabic", "ara"]),
    ("ru", "Russian", ["russian", "rus"]),
    ("hi", "Hindi", []),
    ("nl", "Dutch", []),
    ("pl", "Polish", []),
    ("tr", "Turkish", []),
    ("vi", "Vietnamese", []),
    ("th", "Thai", []),
]
# The first 11 languages are the ones with aliases, and the ones the short list names.
SHORT_LANGUAGE_LIST = 11

# Words read as true and false.
TRUE_WORDS = ["true", "yes", "1", "on"]
FALSE_WORDS = ["false", "no", "0", "off"]
CONFIG_TRUE_WORDS = ["true", "1", "yes", "y", "on"]
CONFIG_FALSE_WORDS = ["false", "0", "no", "n", "off"]

# Voices given to speakers in turn.
VOICES = ["alloy", "echo", "fable", "onyx", "nova", "shimmer"]

# Words in an error message that point at the processor (short and long list).
CPU_ERROR_WORDS = ["svml", "__svml", "llvm", "intel", "mkl", "illegal instruction", "symbol not found"]
CPU_ERROR_WORDS_LONG = CPU_ERROR_WORDS + ["cpu dispatcher", "avx", "cosf8", "sinf8", "expf8"]

# Media types by file extension.
MEDIA_TYPES = {
    ".mp4": "video/mp4",
    ".webm": "video/webm",
    ".mkv": "video/x-matroska",
    ".mov": "video/quicktime",
}
VIDEO_EXTENSIONS = [".mp4", ".mkv", ".mov", ".avi", ".webm"]

# Engines, and whether they need a reference sample.
ENGINES = {
    "xtts": True,
    "bark": False,
    "styletts2": True,
    "piper": False,
    "fishspeech": True,
    "f5": True,
    "remote": False,
}
DEFAULT_ENGINE = "xtts"

# Wording of prompts and messages.
TRANSLATION_PROMPT = (
    "Translate the following text to {lang}. \n"
    "Preserve the meaning, tone, and style. Only output the translation, no explanations.\n\n"
    "Text: {text}\n\n"
    "Translation to {lang}:"
)
SHORT_TRANSLATION_PROMPT = "Translate to {lang}: {text}"
ANALYSIS_SYSTEM = {
    "summary": "You are an expert summarizer. Summarize the following text concisely.",
    "meeting_report": (
        "You are a secretary. Create a structured meeting report with Agenda, Key Points, and Action Items."
    ),
}
ANALYSIS_BODY = "\n\nTEXT:\n"
UNKNOWN_MODE = "Unknown mode"
SILENT_TEXT = "Silent segment (speaker removed or TTS unavailable)"
MARKDOWN_TITLE = "# Transcription Export"

# Sample rates.
SPEECH_RATE = 16000
SYNTH_RATE = 24000
MIX_RATE = 48000

"""Table shapes the operators read and write."""

from pyspark.sql import types as T

TEXT, INT, LONG, REAL, FLAG, TIME = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TASKS = _struct(
    task_id=LONG, filename=TEXT, original_filename=TEXT, file_path=TEXT, source=TEXT, status=TEXT, phase=TEXT,
    progress=REAL, src_lang=TEXT, tgt_lang=TEXT, separate_audio=FLAG, tts_engine=TEXT, whisper_model=TEXT,
    vad_threshold=REAL, output_path=TEXT, error_message=TEXT, created_at=TIME, updated_at=TIME,
    was_running_at_shutdown=FLAG, resume_attempts=INT, last_checkpoint_phase=TEXT, data=T.MapType(TEXT, TEXT),
)
WORKFLOW_TASKS = _struct(
    task_id=LONG, task_name=TEXT, task_order=INT, phase=TEXT, task_group=TEXT, status=TEXT, created_at=TIME,
    started_at=TIME, completed_at=TIME, attempt_count=INT, max_attempts=INT, input_data=TEXT, output_data=TEXT,
    checkpoint_data=TEXT, error_message=TEXT,
)
SEGMENTS = _struct(
    task_id=LONG, idx=INT, start_s=REAL, end_s=REAL, speaker_id=INT, original_text=TEXT, translated_text=TEXT,
    audio_path=TEXT, status=TEXT, error=TEXT,
)
SPEAKERS = _struct(
    task_id=LONG, speaker_id=INT, name=TEXT, action=TEXT, include=FLAG, merged_into=INT,
    merged_speakers=T.ArrayType(INT), sample_path=TEXT,
)
EMBEDDINGS = _struct(task_id=LONG, idx=LONG, embedding=T.ArrayType(REAL))
FRAMES = _struct(series_id=LONG, t=REAL, prob=REAL)
INTERVALS = _struct(series_id=LONG, start_s=REAL, end_s=REAL)
SAMPLES = _struct(series_id=LONG, pos=LONG, value=REAL)
SERIES_META = _struct(series_id=LONG, sample_rate=INT, duration=REAL)
PROGRESS = _struct(task_id=LONG, ts=TIME, phase=TEXT, percent=REAL, message=TEXT)
LOGS = _struct(task_id=LONG, seq=LONG, message=TEXT, style=TEXT)

# One project's state file; everything else in the file is ignored.
PROJECT_STATE = _struct(
    task_id=TEXT, filename=TEXT, status=TEXT, progress=REAL, created_at=TEXT,
    logs=T.ArrayType(_struct(message=TEXT, style=TEXT)), _corrupt_record=TEXT,
)

from seqlab.functions.timecols import epoch_micros, seconds_between, parse_timestamp, ts_text  # noqa: F401
from seqlab.functions.scalar import (  # noqa: F401
    volume_code, answer_letter, array_text, safe_get, count_value, all_equal_first,
)

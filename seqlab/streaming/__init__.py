from seqlab.streaming.sessions import stream_session_counts, session_windows  # noqa: F401
from seqlab.streaming.numbered import number_sessions  # noqa: F401

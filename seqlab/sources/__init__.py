from seqlab.sources.tables import (  # noqa: F401
    read_table, read_distinct_view, read_csv_table, read_json_lines, write_table,
    sample_rows, hash_sample, list_tables, TABLES,
)
from seqlab.sources.adapter import (  # noqa: F401
    answer_log, exp_log, question_structure, user_info, gc_course, CONTROLLED_COURSES,
)

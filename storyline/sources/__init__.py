from .readers import (parse_blocklist, parse_catalog, parse_job_state, read_assets, read_blocklist, read_catalog, read_job_state, read_log,
                      read_provider_hits, read_script_lines, read_scripts)
from .folders import read_text_folders
from .packs import read_text_index, read_texts
from .writers import CAPTION_HEADER, dialogue_line, write_caption_packs, write_captions, write_timeline

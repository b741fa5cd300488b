"""Schemas of the tables. Addresses and sizes are unsigned 64-bit, so DECIMAL(20,0)."""

VA = "decimal(20,0)"
SLICE = f"struct<ptr:{VA},len:{VA},cap:{VA}>"
SPAN = "struct<offset:bigint,size:bigint,va:decimal(20,0)>"

IMAGE_PARTS = (
    "image_id string, path string, length bigint, format string, has_gopclntab boolean, has_go_buildinfo boolean, has_note boolean, "
    "build_id string, info_found boolean, info_version string, mod_text string, scanned_version string, table_version string, "
    "nfunc bigint, heuristic_hits int, text_va decimal(20,0), etext_va decimal(20,0), function_names array<string>"
)
SECTIONS = f"image_id string, slot string, present boolean, offset bigint, size bigint, va {VA}"
SEGMENTS = f"image_id string, ord int, va {VA}, file_off {VA}, size {VA}"
NOTES = "image_id string, ord int, file_off bigint, size bigint"
PCLNTAB = (
    "image_id string, offset bigint, version string, min_lc int, ptr_size int, nfunc bigint, nfiles bigint, funcname_offset bigint, "
    "cu_offset bigint, filetab_offset bigint, pctab_offset bigint, functab_offset bigint, arch string"
)
SOURCE_FILES = "image_id string, ord int, path string"
FUNCTIONS = (
    "image_id string, ord int, func_off bigint, name string, entry_offset bigint, args_size int, start_line int, func_id int, flags int, "
    "deferreturn bigint, pcsp bigint, pcfile bigint, pcln bigint, npcdata bigint, cu_offset bigint, nfuncdata int, source_file string, "
    "end_line int, frame_size int"
)
PC_PAIRS = "array<struct<pc:bigint,value:bigint>>"
FUNCTION_TABLES = f"image_id string, func_off bigint, name string, pcln {PC_PAIRS}, pcsp {PC_PAIRS}, pcfile {PC_PAIRS}, paths array<struct<pc:bigint,path:string>>"
PC_VALUES = "image_id string, func_off bigint, `table` string, ord int, pc_start bigint, pc_end bigint, value bigint, path string"
INLINE = (
    "image_id string, func_off bigint, pc_start bigint, pc_end bigint, idx bigint, function_name string, parent_pc bigint, "
    "start_line int, func_id int, depth int"
)
MODULEDATA = "image_id string, version string, " + ", ".join(
    f"{n} {SLICE if n in ('funcnametab', 'cutab', 'filetab', 'pctab', 'pclntable', 'ftab', 'typelinks', 'itablinks') else VA}"
    for n in (
        "pc_header funcnametab cutab filetab pctab pclntable ftab findfunctab minpc maxpc text etext types etypes rodata gofunc typelinks itablinks"
    ).split()
)
TYPES = (
    f"image_id string, ord int, type_va {VA}, name string, kind string, size {VA}, align int, field_align int, ptr_bytes {VA}, hash bigint, "
    "has_uncommon boolean, has_extra_star boolean, is_named boolean, is_exported boolean, method_count int, exported_method_count int, "
    f"elem_va {VA}, key_va {VA}, len {VA}, dir {VA}, in_count int, out_count int, is_variadic boolean, inputs array<{VA}>, outputs array<{VA}>, "
    f"imethod_count {VA}, imethods array<struct<name:string,type_off:int>>, field_count {VA}, "
    f"fields array<struct<name:string,type_va:{VA},offset:{VA},is_embedded:boolean>>, "
    "methods array<struct<name:string,type_off:int,text_off:int,is_exported:boolean>>"
)
ITABS = f"image_id string, ord int, itab_va {VA}, iface_type_va {VA}, concrete_type_va {VA}, hash bigint"
STRINGS = f"image_id string, header_pos bigint, va {VA}, len int, text string"

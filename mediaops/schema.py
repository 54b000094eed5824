"""Schemas of the stored tables and of the JSON and CSV files read."""

MEDIA = (
    "media string, path string, language string, duration double, total_segments int, width int, height int, "
    "fps double, phase1_status string, phase1_start_time timestamp, phase1_segments_created int, "
    "phase2_status string, phase2_start_time timestamp, phase2_segments_analyzed int, "
    "db_load_status string, db_load_start_time timestamp, db_segments_loaded int, "
    "face_status string, face_start_time timestamp, face_persons_count int, face_detections_count int, "
    "created_at timestamp, updated_at timestamp"
)
SEGMENTS = (
    "id string, media string, path string, segment_index int, start_time double, end_time double, "
    "duration double, description string, keywords string, confidence string, content_type string, "
    "embedding array<float>, search_terms string, search_terms_embedding array<float>, created_at timestamp"
)
ENTITIES = (
    "media string, entity_id string, first_seen double, representative array<float>, name string, "
    "appearances int, created_at timestamp"
)
DETECTIONS = (
    "id long, media string, entity_id string, t double, x int, y int, w int, h int, age int, gender string, "
    "emotion string, det_score double, embedding array<float>, entity_id_batch string, entity_id_alt string, "
    "thumbnail binary, crop_context binary"
)
RESULT_FILE = (
    "video_info struct<video_name:string,total_segments:int,processed_segments:int,success_segments:int,"
    "analysis_complete:boolean,analysis_method:string,timestamp:string>, "
    "segments array<struct<segment_index:int,start_time:double,end_time:double,duration:double,transcript:string,"
    "analysis:string,frame_count:int,success:boolean,parse_error:string,error:string>>"
)
UTTERANCES = "start double, end double, text string, start_formatted string, end_formatted string"
MANIFEST = "videos array<struct<name:string,path:string,language:string,description:string,force:boolean>>"
STILL_METADATA = (
    "status string, error string, "
    "file_info struct<path:string,name:string,size:long,modified:string,dimensions:struct<width:int,height:int>>, "
    "processing_info struct<timestamp:string,processing_time:double,anpr_version:string,min_confidence:double>, "
    "radar_data struct<speed:int,speed_unit:string,direction:string,timestamp:string,confidence:double>, "
    "vehicles array<struct<type:string,bbox:array<int>,confidence:double,is_primary:boolean>>, "
    "license_plates array<struct<text:string,country:string,pattern_type:string,confidence:double,"
    "ocr_method:string,bbox:array<int>>>, "
    "yolo_plate_detections array<struct<bbox:array<int>,expanded_bbox:array<int>,yolo_confidence:double,"
    "extraction_success:boolean,recognized_text:string,region_code:string,country_code:string,"
    "plate_number:string,layout_type:string,ocr_confidence:double,combined_confidence:double>>"
)

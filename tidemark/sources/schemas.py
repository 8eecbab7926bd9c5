"""Schemas of the store and of the interchange files. Never inferred: a field that is null throughout a file would
get a wrong type. Written as DDL, which needs no session."""

from __future__ import annotations

RECORDINGS = "id bigint, filename string, session_name string, created_at bigint, duration_ms bigint, waveform_data string, uuid string, audio_content_hash string"
TAGS = "id bigint, recording_id bigint, timestamp_ms bigint, label string, uuid string, start_ms bigint, end_ms bigint, source string, status string, imported_at bigint"
SAMPLE = "struct<tMs:double,avgDb:double,peakDb:double,minAmp:double,maxAmp:double>"
#: Read as text, as a field that is missing isn't one that is null, and numbers may be written as text.
WAVEFORM = "version string, barDurationMs string, source string, samples array<map<string,string>>"
MANIFEST = (
    "schemaVersion int, recordingId bigint, recordingUuid string, sessionName string, originalSessionName string, voiceNotesOriginalFilename string, recordingLocation string, contextNotes string, filename string, "
    "audioFile string, durationMs bigint, createdAt bigint, codec string, sampleRate int, bitDepth int, channels int, audioContentHash string, exportedAt string"
)
TAG_ITEM = "uuid:string,label:string,startMs:bigint,endMs:bigint,tMs:bigint,source:string,status:string,category:string,speaker:string,language:string,word:string,phonetic:string,note:string"
ASR = "struct<text:string,language:string,model:string,source:string,updatedAt:string,startMs:bigint,endMs:bigint>"
ANNOTATION_ITEM = f"{TAG_ITEM},score:double,splitBy:string,parentSpanId:string,flags:array<string>,speechScore:double,nonSpeechReason:string,f0Med:int,speakerCluster:string,speakerConfidence:double,asr:{ASR}"
MEMBER = "struct<memberId:string,refType:string,uuid:string,startMs:bigint,endMs:bigint,speaker:string,source:string,status:string,outlier:boolean>"
CLUSTERS = (
    f"clusters array<struct<id:string,members:array<{MEMBER}>,confidence:struct<tightness:double,size:int,separation:double,meanDistanceToCentroid:double>,word:string,phonetic:string,language:string,category:string,note:string,"
    "conceptIds:array<string>,curated:boolean,locked:boolean>>"
)
SYNC_STATE = "kits map<string,struct<tagsFingerprint:string,pushed:boolean,pushedAt:string,tagCount:int,audioContentHash:string>>, lastSyncAt string"
REQUIRED_MANIFEST = ("schemaVersion", "recordingId", "recordingUuid", "filename", "audioFile", "durationMs", "createdAt", "sampleRate", "audioContentHash")
EMBEDDINGS = "member_id string, embedding array<double>"

"""Spark schemas of the tables and files that the engine reads and writes."""

MESSAGES = (
    "event_kind string, server_id string, channel_id string, channel_name string, message_id bigint, ts timestamp, "
    "author_id string, author_name string, is_bot boolean, is_webhook boolean, channel_type string, content string, "
    "reply_to_message_id bigint, attachments array<struct<url: string, is_image: boolean>>"
)
REACTIONS = "server_id string, reactor_id string, author_id string, emoji string, is_bot boolean, ts timestamp"
OCR_RESULTS = "message_id bigint, ocr_color string, ocr_gray string"

KEYWORDS_FILE = "keywords array<struct<word: string, heat: double>>, safeWords array<struct<word: string, heat: double>>"
KEYWORDS = "word string, heat double, kind string"

SETTINGS = (
    "struct<word_filter: boolean, delete_filtered_messages: boolean, timeout_for_filtered_messages: boolean, slowmode_alerts: boolean, "
    "log_channel_id: string, alert_channel_id: string, warning_channel_id: string, alert_cooldown_seconds: bigint, save_interval: int, "
    "timeout_mode: string, timeout_base_seconds: bigint, banned_words: array<string>>"
)
SERVER_CONFIG = f"name string, id string, config {SETTINGS}"

CHANNEL_STATS = "struct<channelName: string, channelId: string, messagesPerMinute: double, averageHeatIndex: double, peakHour: int, userInputDiversity: double>"
MEMBER_STATS = (
    "struct<memberName: string, memberId: string, averageHeatLevel: double, messageCount: int, recordHighHeat: double, moderateHeatMessages: int, "
    "moderateHeatAverage: double, highHeatMessages: int, highHeatAverage: double, extremeHeatMessages: int, infractionLevel: int, totalInfractions: int, "
    "lastInfractionDate: string, infractionLevelReductionDate: string, relations: array<struct<targetMemberId: string, affection: double>>>"
)
SERVER_STATS = f"serverName string, serverId string, totalMessagesAnalyzed int, totalInfractions int, channels map<string, {CHANNEL_STATS}>, members map<string, {MEMBER_STATS}>"
SERVER_STATS_LIST = f"serverName string, serverId string, totalMessagesAnalyzed int, totalInfractions int, members array<{MEMBER_STATS}>"

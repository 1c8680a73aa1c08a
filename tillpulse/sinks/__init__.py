from tillpulse.sinks.keyed import KeyedTable
from tillpulse.sinks.panes import PaneStore
from tillpulse.sinks.rollup import Rollup
from tillpulse.sinks.topics import archive_logs, record_topics, topic_sink
from tillpulse.sinks.waiting import WaitingRows

__all__ = ["KeyedTable", "PaneStore", "Rollup", "WaitingRows", "archive_logs", "record_topics", "topic_sink"]

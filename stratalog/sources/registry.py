"""Known log datasets: header formats and masks."""

from __future__ import annotations

from dataclasses import dataclass

from .logs import Format, compile_format


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    header: str
    masks: tuple[str, ...] = ()

    def format(self) -> Format:
        return compile_format(self.header)


# Formats and masks that define the datasets.
DATASETS = {
    d.name: d
    for d in (
        Dataset("HDFS", "HDFS/HDFS_full.log", "<Date> <Time> <Pid> <Level> <Component>: <Content>", (r"/?(\d+\.){3}\d+(:\d+)?",)),
        Dataset("Hadoop", "Hadoop/Hadoop_full.log", r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>"),
        Dataset("Spark", "Spark/Spark_full.log", "<Date> <Time> <Level> <Component>: <Content>"),
        Dataset("Zookeeper", "Zookeeper/Zookeeper_full.log", r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>", (r"(/|)(\d+\.){3}\d+(:\d+)?",)),
        Dataset("BGL", "BGL/BGL_full.log", "<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>"),
        Dataset("HPC", "HPC/HPC_full.log", "<LogId> <Node> <Component> <State> <Time> <Flag> <Content>", (r"node-D?\d+\\?", r"node-D?\[.*?\]")),
        Dataset("Thunderbird", "Thunderbird/Thunderbird_full.log", r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>"),
        Dataset("Linux", "Linux/Linux_full.log", r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>", (r"J([a-z]{2})",)),
        Dataset("HealthApp", "HealthApp/HealthApp_full.log", r"<Time>\|<Component>\|<Pid>\|<Content>"),
        Dataset("Apache", "Apache/Apache_full.log", r"\[<Time>\] \[<Level>\] <Content>", (r"HTTP/\d\.\d",)),
        Dataset("Proxifier", "Proxifier/Proxifier_full.log", r"\[<Time>\] <Program> - <Content>", (r"<\d+\ssec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"[KGTM]B")),
        Dataset("OpenSSH", "OpenSSH/OpenSSH_full.log", r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>", (r"([\w-]+\.){2,}[\w-]+", r"HTTP/\d\.\d")),
        Dataset("OpenStack", "OpenStack/OpenStack_full.log", r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>", (r"HTTP/\d\.\d",)),
        Dataset("Mac", "Mac/Mac_full.log", r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>", (r"([\w-]+\.){2,}[\w-]+",)),
        Dataset("LoFI", "Industry-clean/Industry-clean_full.log", "<Content>", (r"(?<=request-id:)routeid(?=,)",)),
        Dataset("CTS", "CTS/CTS_full.log", r"\[<ID>\]\[<Process>\] <Content>", (r"\d+/\d+/\d+$",)),
        Dataset("HiBench", "HiBench/HiBench_full.log", r"\[<Time>\] <Content>", (r"hdfs://[a-zA-Z0-9._-]+(/[a-zA-Z0-9._/-]*)*", r"^/[a-zA-Z0-9._-]+(/[a-zA-Z0-9._-]*)*")),
    )
}


@dataclass(frozen=True)
class Config:
    """What a run needs. ``mask``: ``before`` masks, then clusters; ``add`` and ``no`` don't mask."""

    dataset: str = "Apache"
    corrected_truth: bool = False
    complexity: int = 0
    frequency: float = 0.0
    mask: str = "before"
    samples: int = 5
    mode: str = "batch"

    def masks(self) -> tuple[str, ...]:
        return DATASETS[self.dataset].masks if self.mask == "before" else ()

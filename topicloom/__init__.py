"""topicloom: text analytics and topic modelling as Spark DataFrame plans."""

__version__ = "0.1.0"

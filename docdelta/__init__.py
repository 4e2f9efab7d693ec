"""docdelta: a Spark-native engine for comparing page-delivered document pairs."""

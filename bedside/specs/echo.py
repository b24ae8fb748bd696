"""Labelled fields of echocardiography reports."""

# fixed values: field name -> capture pattern
TEXT_FIELDS = {
    "indication": r"Indication: (.*?)\n",
    "bp": r"BP \(mm Hg\): (.*?)\n",
    "status": r"Status: (.*?)\n",
    "test": r"Test: (.*?)\n",
    "doppler": r"Doppler: (.*?)\n",
    "contrast": r"Contrast: (.*?)\n",
    "technicalquality": r"Technical Quality: (.*?)\n",
}
NUMBER_FIELDS = {
    "height": r"Height: \(in\) (.*?)\n",
    "weight": r"Weight \(lb\): (.*?)\n",
    "bsa": r"BSA \(m2\): (.*?) m2\n",
    "bpsys": r"BP \(mm Hg\): ([0-9]+)/[0-9]+?\n",
    "bpdias": r"BP \(mm Hg\): [0-9]+/([0-9]+?)\n",
    "hr": r"HR \(bpm\): ([0-9]+?)\n",
}
CLOCK_TIME = r"Date/Time: [\[\]0-9*-]+ at ([0-9:]+)"
CATEGORY = "Echo"

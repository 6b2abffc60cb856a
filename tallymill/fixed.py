"""Word lists, stop strings, templates and task names.

Everything here must equal the published task definitions for results to be
comparable, so the lists are kept as plain text in their natural order.
"""

from __future__ import annotations

# --- Fixed values: grammar vocabulary -------------------------------------
# Statement keywords become <word_stmt>, expression keywords become <word>.
STATEMENT_WORDS = [
    "with", "def", "class", "try", "except", "finally", "match", "while",
    "assert", "del", "case", "elif",
]
EXPRESSION_WORDS = [
    "and", "or", "not", "is", "return", "raise", "break", "continue", "pass",
    "global", "nonlocal", "from", "as", "print", "exec", "in", "true", "false",
    "none",
]
OPERATOR_TOKENS = {
    "//": "<floordiv>", "<": "<l>", ">": "<g>", "<<": "<lshift>",
    ">>": "<rshift>", "==": "<eq>", "!=": "<ne>", "<=": "<le>", ">=": "<ge>",
    "<>": "<lgne>", "not in": "<notin>", "is not": "<isnot>",
    "+=": "<augadd>", "-=": "<augsub>", "*=": "<augmul>", "/=": "<augdiv>",
    "@=": "<augmatmul>", "//=": "<augfloordiv>", "%=": "<augmod>",
    "**=": "<augpow>", ">>=": "<augrshift>", "<<=": "<auglshift>",
    "&=": "<augand>", "^=": "<augxor>", "|=": "<augor>", "->": "<arrow>",
    "ellipsis": "<ellipsis>",
}
# Tokens whose surface is shared or structural: surface by token.
STRUCTURAL_TOKENS = {
    "<from>": "from", "<ellipsis>": "ellipsis", "<yield>": "yield",
    "<else_stmt>": "else", "<line_sep>": "\n", "<except_group_stmt>": "except",
    "<def_stmt>": "def", "<lambda>": "lambda", "<concat>": "+",
    "<await>": "await", "<power>": "**", "<import_stmt>": "import",
    "<else>": "else", "<if>": "if", "<import_from_stmt>": "from import",
    "<finally_stmt>": "finally", "<for>": "for", "<if_stmt>": "if",
    "<in>": "in", "<block_end>": "}", "<times>": "*",
    "<import_from_future_stmt>": "from future import", "<block_start>": "{",
    "<elif_stmt>": "elif", "<except_stmt>": "except",
    "<async_keyword>": "async", "<case_stmt>": "case", "<for_stmt>": "for",
}

# --- Fixed values: stop strings by task family ----------------------------
STOPS = {
    "humaneval": ["\nclass", "\ndef", "\n#", "\n@", "\nprint", "\nif", "\n```"],
    "humaneval-compact": ["<def_stmt>", "<class_stmt>", "@"],
    "mbpp": ["\nclass", "\nassert", '\n"""', "\nprint", "\nif", "\n<|/", "\n```"],
    "apps": ["\nQUESTION", "\n---", "\nANSWER"],
    "perturbed-humaneval": ["\nclass", "\ndef", "\n#", "\n@", "\nprint", "\nif"],
    "ds1000": ["</code>", "# SOLUTION END"],
    "pal": ["\n\n\n"],
    "conala": ["\n"],
    "concode": ["\n"],
    "codexglue_text_to_text": ["\n"],
    "codexglue_code_to_text-python": ["'''", '"""'],
    "codexglue_code_to_text": ["\n"],
    "instruct-humaneval": ["if __name__", "\nprint", "\nclass"],
    "instruct_wizard_humaneval": [],
    "parity": [
        "\nclass", "\ndef", "\n#", "\n@", "\nprint", "\nif",
        "<commit_before>", "<commit_msg>", "<commit_after>", "<|endoftext|>",
    ],
    "python_bugs": [
        "\nclass", "\n#", "\ndef", "\nassert", '\n"', "\nprint", "\nif",
        "<commit_before>", "<commit_msg>", "<commit_after>", "<|endoftext|>",
    ],
    "quixbugs": [
        "\ndef", "\nclass", "\n#", "\n@", "\nprint", "\nif", "###", "///",
        "<|endoftext|>",
    ],
    "quixbugs-edit": [
        "<commit_before>", "<commit_msg>", "<commit_after>", "<|endoftext|>",
    ],
}
PACK_STOPS = {
    "python": ["\nclass", "\ndef", "\n#", "\n@", "\nprint", "\nif", "\nassert"],
    "cpp": [],
    "js": [],
    "java": [],
    "go": ["\n//", "\nfunc main(", "struct", "\nfunc"],
    "rust": [],
}
PACK_STYLE_STOPS = {
    "edit": ["<commit_before>", "<commit_msg>", "<commit_after>"],
    "starchat": ["<|end|>"],
    "diff": ["<commit_before>", "<commit_msg>", "<commit_after>"],
    "diff-carper": ["<BEF>", "<MSG>", "<DFF>", "\\ No newline at end of file"],
}
END_OF_TEXT = "<|endoftext|>"
COMPACT_STOPS = ["\nif", "\nprint", "<if_stmt>", "\nassert"]
MULTI_STOPS = ["\nclass", "\ndef", "\n#", "\n@", "\nprint", "\nif"]

# --- Fixed values: languages ----------------------------------------------
PACK_LANGUAGES = ["python", "cpp", "js", "java", "go", "rust"]
PACK_LANGUAGE_NAMES = {
    "python": "Python", "cpp": "C++", "js": "JavaScript", "java": "Java",
    "go": "Go", "rust": "Rust",
}
PACK_EXTENSIONS = {
    "python": "py", "cpp": "cpp", "js": "js", "java": "java", "go": "go",
    "rust": "rs",
}
MULTI_LANGUAGES = [
    "py", "sh", "cpp", "cs", "d", "go", "java", "js", "jl", "lua", "pl", "php",
    "r", "rkt", "rb", "rs", "scala", "swift", "ts",
]
DOC_LANGUAGES = ["python", "java", "javascript", "ruby", "php", "go"]
TRANSLATION_LANGUAGES = {
    "da_en": "danish", "zh_en": "chinese", "no_en": "norwegian",
    "lv_en": "latvian",
}
LIBRARIES = [
    "All", "Numpy", "Pandas", "Scipy", "Matplotlib", "Sklearn", "Tensorflow",
    "Pytorch",
]
PERTURBATIONS = ["format", "func_name", "natgen", "nlaugmenter"]

# --- Fixed values: imports added before a program is run -------------------
PYTHON_IMPORTS = [
    "import math", "import re", "import sys", "import copy", "import datetime",
    "import itertools", "import collections", "import heapq",
    "import statistics", "import functools", "import hashlib", "import numpy",
    "import numpy as np", "import string", "from typing import *",
    "from collections import *",
]
GO_PACKAGES = [
    "math", "strings", "fmt", "strconv", "time", "bytes", "regexp", "sort",
    "math/rand", "crypto/md5",
]
CPP_IMPORTS = [
    "using namespace std;", "#include<stdlib.h>", "#include<algorithm>",
    "#include<cmath>", "#include<math.h>", "#include<numeric>",
    "#include<stdio.h>", "#include<vector>", "#include<set>", "#include<map>",
    "#include<queue>", "#include<stack>", "#include<list>", "#include<deque>",
    "#include<boost/any.hpp>", "#include<string>", "#include<climits>",
    "#include<cstring>", "#include<iostream>", "#include<sstream>",
    "#include<fstream>",
]

# --- Fixed values: prompt templates ----------------------------------------
# {inp} is the instruction joined with its context, {base} the code to continue.
ANSWER_TEMPLATES = {
    "continue": "{base}",
    "instruct": "{inp}\n\n{base}",
    "octocoder": "Question: {inp}\n\nAnswer:\n{base}",
    "octogeex": "Question: {inp_stripped}\n\nAnswer:\n{base}",
    "starchat": "<|system|>\n<|end|>\n<|user|>\n{inp}<|end|>\n<|assistant|>\n{base}",
    "starcodercommit": "<commit_before><commit_msg>{inp}<commit_after>{base}",
    "instructcodet5p": (
        "Below is an instruction that describes a task. Write a response that "
        "appropriately completes the request.\n\n### Instruction:\n{inp}\n\n"
        "### Response:{base}"
    ),
    "wizardcoder": (
        "Below is an instruction that describes a task. Write a response that "
        "appropriately completes the request.\n\n### Instruction:\n{inp}\n\n"
        "### Response:\n{base}"
    ),
    "codellama": "[INST] {inp_stripped} [/INST] {base}",
}
CONTEXT_FIRST = ["continue", "instruct"]
FIX_TEMPLATES = {
    "file": (
        "<file_name>\n{file}\n<commit_before>\n{context}\n<commit_msg>\n"
        "{instruction}<commit_after>\n{base}"
    ),
    "starcodercommit": (
        "<commit_before>{context}<commit_msg>{instruction}<commit_after>{base}"
    ),
    "diff": "<commit_before>{context}<commit_msg>{instruction}<commit_after>",
    "diff-carper": "<NME> {file}\n<BEF> {context}\n<MSG> {instruction}\n<DFF>",
}
MUTATION_TEMPLATES = {
    "diff": "<NME> {task}.py\n<BEF> {code}\n<MSG> Fixed bugs",
    "prompt_carper": (
        "# A buggy implementation\n#!/usr/bin/python3\n{code}\n# Fixed bugs\ndef"
    ),
    "prompt": (
        "#!/usr/bin/python3\n# A buggy implementation\n{code}\n# Fixed bugs\ndef"
    ),
    "edit": "<commit_before>{code}<commit_msg>Fix bugs<commit_after>",
}
PROGRAM_TEMPLATES = {
    "edit": "<commit_before>{code}<commit_msg>Fix bug in {name}<commit_after>",
    "edit-openai": "{code}",
    "prompt": "# Buggy function\n{code}\n# Fixed function\ndef",
    "prompt_codex": (
        "### fix the bug in the following function\n{code}\n### fixed function"
    ),
}
BUG_TEMPLATES = {
    "prompt_carper": (
        "# A buggy implementation\n#!/usr/bin/python3\n{code}\n{instruction}\ndef"
    ),
    "prompt": (
        "#!/usr/bin/python3\n# A buggy implementation\n{code}\n{instruction}\ndef"
    ),
    "edit": "<commit_before>{code}<commit_msg>{instruction}<commit_after>",
}
BUG_INSTRUCTIONS = {
    "prompt_carper": {
        "bin-op": "# Fixed binary operator",
        "var-misuse": "# Fixed incorrect variable name",
    },
    "prompt": {
        "bin-op": "# Fixed binary operator",
        "var-misuse": "# Fixed incorrect variable name",
    },
    "edit": {
        "bin-op": "Fix binary operator",
        "var-misuse": "Fix incorrect variable name",
    },
}
SCRIPT_TEMPLATE = (
    "Below is an instruction that describes a task. Write a response that "
    "appropriately completes the request.\n\n\n### Instruction:\nCreate a "
    "Python script for this problem:\n{inp}\n\n### Response:"
)
DOC_SUFFIX = {
    "python": '\n""" The goal of this function is to:\n',
    "ruby": "\n=begin The goal of this function is to:\n",
    "other": "\n/* The goal of this function is to:\n",
}
INFILL_MARKS = {
    "incoder": ("", "<|mask:0|>", "<|mask:0|>", "<|endofmask|>"),
    "santacoder": ("<fim-prefix>", "<fim-suffix>", "<fim-middle>", "<|endoftext|>"),
    "starcoder": ("<fim_prefix>", "<fim_suffix>", "<fim_middle>", "<|endoftext|>"),
}
CONALA_ENTRY = "Answer the following instructions in one line of Python code:\n"
CONCODE_ENTRY = "Answer the following instructions in a one line of Java code:\n"
# Separator the published two-shot prompts keep before each solution mark.
SHOT_GAP = " " * 19
MATH_SHOTS = 8
MATH_MARK = "# solution in Python:"
MATH_POST_SCRIPT = "print(solution())"

# --- Fixed values: wording of prompts ---------------------------------------
QUESTION_MARK = "\nQUESTION:\n"
ANSWER_MARK = "\nANSWER:\n"
STANDARD_INPUT = "\nUse Standard Input format"
CALL_BASED = "\nUse Call-Based format"
ASK_FIX = "Fix bugs in {name}."
ASK_DESCRIBE = (
    "Provide a concise natural language description of the code using at most {n} characters."
)
ASK_WRITE = "Write functional code in {language} according to the description."
PARITY_PROGRAM = (
    'def parity(b1,b2,b3,b4):\n    """Return binary parity of a sequence of '
    'input bits. Return 0 for even parity, 1 for odd parity."""\n    '
    "bit_sum = sum([{terms}])\n    return bit_sum % {modulus}"
)

# --- Fixed values: outcome rules -------------------------------------------
EVALUATOR_OF = {
    "rb": "ruby", "lua": "lua", "python": "python", "py": "python",
    "notypes.py": "python", "julia": "julia", "java": "java", "rust": "rust",
    "rs": "rust", "swift": "swift", "racket": "racket", "rkt": "racket",
    "javascript": "javascript", "js": "javascript", "cpp": "cpp", "cs": "cs",
    "php": "php", "humaneval_to_dlang.py": "d", "d": "d", "r": "r",
    "humaneval_to_r.py": "r", "jl": "julia", "ts": "ts", "go": "go",
    "go_test.go": "go", "pl": "pl", "sh": "sh", "scala": "scala",
}
LEADERBOARD_TASKS = [
    "humaneval", "multiple-js", "multiple-java", "multiple-cpp",
    "multiple-swift", "multiple-php", "multiple-d", "multiple-jl",
    "multiple-lua", "multiple-r", "multiple-rkt", "multiple-rb", "multiple-rs",
]
TIMING_SCOPES = [(0, 100), (100, 500), (500, 2000), (2000, 5000)]
CAPTURE_CHARS = 2048
IGNORED_LABEL = -100


def grammar_tokens() -> list[str]:
    """The special tokens, distinct and sorted."""
    names = {f"<{word}_stmt>" for word in STATEMENT_WORDS}
    names |= {f"<{word}>" for word in EXPRESSION_WORDS}
    return sorted(names | set(OPERATOR_TOKENS.values()) | set(STRUCTURAL_TOKENS))


# --- Fixed values: parameter grids of the task names ------------------------
TASK_GRIDS = [
    ("apps", "apps-{level}", {"level": ["introductory", "interview", "competition"]}),
    ("code_to_text", "codexglue_code_to_text-{lang}", {"lang": [*DOC_LANGUAGES, "python-left"]}),
    ("text_to_text", "codexglue_text_to_text-{pair}", {"pair": list(TRANSLATION_LANGUAGES)}),
    ("multiple", "multiple-{lang}", {"lang": MULTI_LANGUAGES}),
    ("single", "{task}", {"task": ["conala", "concode", "mbpp", "parity", "python_bugs", "quixbugs",
                                   "instruct_wizard_humaneval"]}),
    ("humaneval", "humaneval{variant}", {"variant": ["", "-unstripped", "-compact"]}),
    ("instruct", "instruct-humaneval{context}", {"context": ["", "-nocontext"]}),
    ("ds1000", "ds1000-{library}-{mode}", {
        "library": [library.lower() for library in LIBRARIES], "mode": ["completion", "insertion"]}),
    ("fix", "humanevalfix{mode}-{lang}", {"mode": ["tests", "docs"], "lang": PACK_LANGUAGES}),
    ("explain", "humanevalexplain{mode}-{lang}", {
        "mode": ["describe", "synthesize"], "lang": PACK_LANGUAGES}),
    ("synthesize", "humanevalsynthesize-{lang}", {"lang": PACK_LANGUAGES}),
    ("pal", "pal-{source}-{how}", {
        "source": ["gsm8k", "gsmhard"], "how": ["greedy", "majority_voting"]}),
    ("perturbed", "perturbed-humaneval-{category}-num_seeds_{seeds}", {
        "category": PERTURBATIONS, "seeds": [str(seeds) for seeds in range(1, 11)]}),
]


def task_names() -> list[str]:
    """Every task name, from the parameter grids that generate them."""
    names = [f"apps-{level}" for level in ("introductory", "interview", "competition")]
    names += [f"codexglue_code_to_text-{lang}" for lang in DOC_LANGUAGES]
    names += ["codexglue_code_to_text-python-left"]
    names += [f"codexglue_text_to_text-{pair}" for pair in TRANSLATION_LANGUAGES]
    names += [f"multiple-{lang}" for lang in MULTI_LANGUAGES]
    names += ["conala", "concode", "mbpp", "parity", "python_bugs", "quixbugs"]
    names += ["humaneval", "humaneval-unstripped", "humaneval-compact"]
    names += ["instruct-humaneval", "instruct-humaneval-nocontext"]
    names += ["instruct_wizard_humaneval"]
    names += [
        f"ds1000-{library.lower()}-{mode}"
        for library in LIBRARIES for mode in ("completion", "insertion")
    ]
    names += [
        f"humanevalfix{mode}-{lang}"
        for lang in PACK_LANGUAGES for mode in ("tests", "docs")
    ]
    names += [
        f"humanevalexplain{mode}-{lang}"
        for lang in PACK_LANGUAGES for mode in ("describe", "synthesize")
    ]
    names += [f"humanevalsynthesize-{lang}" for lang in PACK_LANGUAGES]
    names += [
        f"pal-{source}-{how}"
        for how in ("greedy", "majority_voting") for source in ("gsm8k", "gsmhard")
    ]
    names += [
        f"perturbed-humaneval-{category}-num_seeds_{seeds}"
        for category in PERTURBATIONS for seeds in range(1, 11)
    ]
    return sorted(names)


def stops_for(task: str, style: str = "") -> list[str]:
    """Stop strings of a task name under a prompt style."""
    if task.startswith("humanevalfix") or task.startswith("humanevalexplain") or (
        task.startswith("humanevalsynthesize")
    ):
        stops = list(PACK_STOPS[task.rsplit("-", 1)[1]])
        if style.startswith("edit"):
            stops += PACK_STYLE_STOPS["edit"]
        elif style == "starchat":
            stops += PACK_STYLE_STOPS["starchat"]
        elif style in ("diff", "diff-carper"):
            stops = list(PACK_STYLE_STOPS[style])
        return stops + [END_OF_TEXT]
    if task == "quixbugs" and style == "edit":
        return STOPS["quixbugs-edit"]
    if task in ("codexglue_code_to_text-python", "codexglue_code_to_text-python-left"):
        return STOPS["codexglue_code_to_text-python"]
    if task.startswith("multiple-"):
        return MULTI_STOPS
    if task == "humaneval-unstripped":
        return STOPS["humaneval"]
    if task == "instruct-humaneval-nocontext":
        return STOPS["instruct-humaneval"]
    if task in STOPS:
        return STOPS[task]
    family = next(
        name for name in (
            "apps", "perturbed-humaneval", "ds1000", "pal",
            "codexglue_text_to_text", "codexglue_code_to_text",
        ) if task.startswith(name)
    )
    return STOPS[family]

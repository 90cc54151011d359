from __future__ import annotations

import pytest
from quern.llm import wrappers

PAGES = [
    "<html class='no-sidebar'><body class='has-sidebar'>{}</body></html>",
    "<body><article class='post no-comments'>{}</article></body>",
    "<body><main id='widget-area'>{}</main></body>",
    "<body><div class='with-sidebar'><article>{}</article></div></body>",
    "<body><div class='page-widget'><main><article class='post related'>{}</article></main></div></body>",
]


@pytest.mark.parametrize("page", PAGES)
@pytest.mark.parametrize("pages", [1, 8])
def test_names_alone_exclude_no_whole_page(page, pages):
    texts = [f"Text {i} of the page." for i in range(pages)]
    other = "<nav>Links</nav><div class='ad'>Buy</div><div hidden>No</div>"
    html = [page.format(f"<p>{t}</p>{other}") for t in texts]
    assert wrappers.extracted(html) == texts


def test_comments_stay_out():
    comments = "<ol class='comment-list'><li><article class='comment'><p>Me too</p></article></li></ol>"
    page = "<body class='has-sidebar'><main><article><p>Text</p></article>" + comments + "</main></body>"
    assert wrappers.extracted([page]) == ["Text"]


def test_tags_and_roles_still_exclude():
    page = "<body><article><p>Text</p></article><nav><article class='x'><p>No</p></article></nav></body>"
    assert wrappers.extracted([page]) == ["Text"]
